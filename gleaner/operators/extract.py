"""Parsing: text, Markdown and HTML into sections; line clean-up.

Sequential parsers run as Arrow-batched functions returning arrays of
(heading_path, content, start, end); what a column can say stays in the JVM.
"""

from __future__ import annotations

import csv
import io
import re
from html.parser import HTMLParser
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import collapsed, column, strip

SECTIONS = "array<struct<heading_path: array<string>, content: string, start_char_idx: int, end_char_idx: int>>"


def plain_text(x) -> Column:
    return strip(F.regexp_replace(column(x), "\r\n", "\n"))


def single_section(x) -> Column:
    """The whole text as one section without heading; none for an empty text."""
    text = column(x)
    one = F.struct(F.array().cast("array<string>").alias("heading_path"), text.alias("content"), F.lit(0).alias("start_char_idx"), F.length(text).alias("end_char_idx"))
    return F.when(F.length(text) > 0, F.array(one)).otherwise(F.array().cast(SECTIONS))


def without_front_matter(x) -> Column:
    return F.regexp_replace(column(x), r"(?s)\A---\n(?=.*?\n---\n)(?:(?!\n---\n).)*\n---\n", "")


# The Markdown that becomes plain text, in the order of the passes, and what stays of it.
MARKDOWN = (
    (r"(?s)```[^\n]*\n(.*?)```", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(?m)^[>\-*+]\s+", ""),
    (r"[*_~`]", ""),
    (r"<[A-Za-z/!][^>]*>", ""),
)


def markdown_text(x) -> Column:
    """Markdown to plain text by ordered passes; tags are dropped and the basic character references decoded."""
    out = column(x)
    for pattern, new in MARKDOWN:
        out = F.regexp_replace(out, pattern, new)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


# Fixed value: where str.splitlines() breaks.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
_LINES = re.compile(BREAKS)


def _sections_at_headings(md: str) -> list[dict]:
    """Sections between ATX headings; what stands before the first is dropped."""
    found = [(m.start(), m.end(), len(m[1]), m[2].strip()) for m in re.finditer(r"(?m)^(#{1,6})\s+(.+?)\s*$", md)]
    trail: list[str] = []
    out = []
    for here, after in zip(found, [f[0] for f in found[1:]] + [len(md)]):
        _, begin, level, title = here
        trail = [*trail[: level - 1], title]
        out.append({"heading_path": trail, "content": md[begin:after], "start_char_idx": begin, "end_char_idx": after})
    return out


def _sections_by_line(md: str) -> list[dict]:
    """Like the above, but with the part before the first heading, and offsets as if sections were two characters apart."""
    out: list[dict] = []
    trail: list[str] = []
    held: list[str] = []
    at = 0
    for line in [*_LINES.split(md), None]:
        m = re.match(r"(#{1,6})\s+(.*)\Z", line.strip()) if line is not None else None
        if line is not None and not m:
            held.append(line)
            continue
        body = "\n".join(held).strip()
        held = []
        if body:
            out.append({"heading_path": trail, "content": body, "start_char_idx": at, "end_char_idx": at + len(body)})
            at += len(body) + 2
        if m:
            trail = trail[: len(m[1]) - 1] + ([m[2].strip()] if m[2].strip() else [])
    return out


def _heading_sections(md) -> Column:

    def batch(md: pd.Series) -> pd.Series:
        return md.map(lambda s: _sections_at_headings(s or ""))

    return F.pandas_udf(batch, SECTIONS)(column(md))


def markdown_sections(x) -> Column:
    """Sections with their text; those without any are dropped."""
    plain = F.transform(_heading_sections(x), lambda s: s.withField("content", markdown_text(s["content"])))
    return F.filter(plain, lambda s: s["content"] != "")


def line_sections(md) -> Column:

    def batch(md: pd.Series) -> pd.Series:
        return md.map(lambda s: _sections_by_line(s or ""))

    return F.pandas_udf(batch, SECTIONS)(column(md))


_cell = str.maketrans({"|": r"\|", "\n": " "})


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a Markdown table: short rows filled up, bars escaped, line ends as spaces, the first row as header."""
    filled = list(zip(*zip_longest(*rows, fillvalue="")))
    if not filled:
        return ""
    filled.insert(1, ("---",) * len(filled[0]))
    return "\n".join(f"| {' | '.join(str(c).translate(_cell) for c in r)} |" for r in filled)


def csv_markdown(x, sep) -> Column:
    """Delimited text as a Markdown table (quotes and multi-line cells included)."""

    def batch(x: pd.Series, sep: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else table_markdown([r for r in csv.reader(io.StringIO(s), delimiter=d)]) for s, d in zip(x, sep)])

    return F.pandas_udf(batch, "string")(column(x), column(sep))


def block_document(blocks) -> Column:
    """struct(markdown, sections) of an array of (heading, value): each as ``## heading`` and its value, two line ends between.

    A section's offsets are those of its value in the Markdown. Blocks without text are left out.
    """
    kept = F.filter(F.transform(column(blocks), lambda b: F.struct(b["heading"].alias("heading"), strip(b["value"]).alias("value"))), lambda b: b["value"] != "")
    head = lambda b: F.when(F.coalesce(b["heading"], F.lit("")) != "", F.concat(F.lit("## "), b["heading"], F.lit("\n\n"))).otherwise("")
    before = lambda all_, k: F.aggregate(F.slice(all_, 1, k), F.lit(0), lambda n, b: n + F.length(head(b)) + F.length(b["value"]) + 2)

    def section(all_: Column, b: Column, k: Column) -> Column:
        start = before(all_, k) + F.length(head(b))
        path = F.when(F.coalesce(b["heading"], F.lit("")) != "", F.array(b["heading"])).otherwise(F.array().cast("array<string>"))
        return F.struct(path.alias("heading_path"), markdown_text(b["value"]).alias("content"), start.alias("start_char_idx"), (start + F.length(b["value"])).alias("end_char_idx"))

    named = F.transform(F.array(kept), lambda all_: F.struct(F.array_join(F.transform(all_, lambda b: F.concat(head(b), b["value"])), "\n\n").alias("markdown"), F.transform(all_, lambda b, k: section(all_, b, k)).alias("sections")))
    return named[0]


class _Blocks(HTMLParser):
    """Sections of a page: headings h1 to h3 in a stack; p, li, table, pre, blockquote as content, outermost first."""

    skipped = frozenset(("script", "style", "noscript", "nav", "footer"))
    content = frozenset(("p", "li", "table", "pre", "blockquote"))
    void = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.trail: list[str] = []
        self.held: list[str] = []
        self.text: list[str] = []
        self.rows: list[list[str]] = []
        self.out: list[dict] = []
        self.at = 0
        self.title: list[str] = []

    def words(self) -> str:
        text = " ".join(t for t in (s.strip() for s in self.text) if t)
        self.text = []
        return text

    def inside(self) -> str | None:
        return next((t for t in reversed(self.open) if t in self.content or t in ("h1", "h2", "h3")), None)

    def flush(self) -> None:
        body = "\n".join(self.held).strip()
        self.held = []
        if body:
            self.out.append({"heading_path": list(self.trail), "content": body, "start_char_idx": self.at, "end_char_idx": self.at + len(body)})
            self.at += len(body) + 2

    def close_block(self, tag: str) -> None:
        """What an element gave, when it ends or another begins."""
        if "table" in self.open and tag != "table":
            return
        if tag == "table":
            if self.rows:
                self.held.append(table_markdown(self.rows))
            self.rows, self.text = [], []
            return
        text = self.words()
        if tag in ("h1", "h2", "h3"):
            self.flush()
            self.trail = self.trail[: int(tag[1]) - 1] + ([text] if text else [])
        elif text:
            self.held.append(f"- {text}" if tag == "li" else text)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.void:
            return
        if tag in self.skipped:
            self.hidden += 1
        elif not self.hidden:
            if tag in ("p", "li", "h1", "h2", "h3", "table", "ul", "ol", "pre", "blockquote") and (now := self.inside()) and now != "table" and "table" not in self.open:
                self.close_block(now)
                if now == "p" or (now == "li" and tag == "li"):
                    self.drop(now)
            elif tag in ("tr", "td", "th") and "table" in self.open:
                self.cell()
                if tag == "tr":
                    self.rows.append([])
        self.open.append(tag)

    def cell(self) -> None:
        if any(t in ("td", "th") for t in self.open):
            for t in ("td", "th"):
                if t in self.open:
                    self.drop(t)
            if self.rows:
                self.rows[-1].append(self.words())
        self.text = []

    def drop(self, tag: str) -> None:
        k = len(self.open) - 1 - self.open[::-1].index(tag)
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipped:
            self.hidden = max(0, self.hidden - 1)
        if tag not in self.open:
            return
        if not self.hidden:
            if tag in ("td", "th", "tr") and "table" in self.open:
                self.cell()
            elif tag == "table":
                self.cell()
                self.close_block(tag)
            elif tag in self.content or tag in ("h1", "h2", "h3"):
                self.close_block(tag)
        if tag in self.open:
            self.drop(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden and self.inside():
            self.text.append(data)


def html_sections_of(html: str) -> list[dict]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    if now := parser.inside():
        parser.cell() if now == "table" else None
        parser.close_block(now)
    parser.flush()
    return parser.out


def html_sections(html) -> Column:

    def batch(html: pd.Series) -> pd.Series:
        return html.map(lambda s: html_sections_of(s or ""))

    return F.pandas_udf(batch, SECTIONS)(column(html))


def precleaned_html(x, tags=("script", "style", "noscript", "nav", "footer"), tables: bool = True) -> Column:
    """Without the named elements, one pass each (elements of one name do not nest)."""
    out = column(x)
    for tag in (*tags, *(() if tables else ("table",))):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return out


def html_title(x, otherwise=None) -> Column:
    title = strip(F.regexp_replace(F.regexp_extract(column(x), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(title != "", title).otherwise(column(otherwise) if otherwise is not None else F.lit(None))


def html_links(x) -> Column:
    return F.regexp_extract_all(column(x), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*\"([^\"]*)\""), 1)


def high_link_density(n_links, link_chars, text_chars) -> Column:
    n, part, whole = column(n_links), column(link_chars), column(text_chars)
    return (n >= 3) & (whole > 0) & (whole < 600) & (part / whole > 0.7)


def kept_lines(x, times: int = 3, most_chars: int = 80) -> Column:
    """The lines of a text without blank ones, short ones that occur ``times`` or more, and menu switches.

    Inside the row: lines sorted by their levelled form stand beside their like, so one that has
    ``times`` - 1 like it next to it, on either side, is repeated.
    """
    split = F.transform(F.split(column(x), BREAKS), lambda line, k: F.struct(collapsed(line).alias("norm"), k.alias("pos"), strip(line).alias("line")))
    ordered = F.array_sort(F.filter(split, lambda s: s["line"] != ""))

    def kept(rows: Column) -> Column:
        at = lambda k: F.get(rows, k)["norm"]

        def repeated(k: Column) -> Column:
            out = F.lit(times <= 1)
            for back in range(times):
                out = out | F.coalesce((k >= back) & (at(k - back) == at(k - back + times - 1)), F.lit(False))
            return out

        return F.filter(rows, lambda s, k: ~((F.length(s["norm"]) <= most_chars) & repeated(k)) & ~s["norm"].isin("show menu", "hide menu"))

    # ``transform`` over an array of one gives the sorted lines a name, so that they are computed once.
    found = F.flatten(F.transform(F.array(ordered), kept))
    return F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["pos"].alias("pos"), s["line"].alias("line")))), lambda s: s["line"])


def deduped_lines(df: DataFrame, key: str, text: str, times: int = 3, most_chars: int = 80) -> DataFrame:
    """``key`` and the text without its blank lines, its short lines that occur ``times`` or more, and menu switches; each row by itself."""
    rows = df.select(key, F.coalesce(kept_lines(text, times, most_chars), F.array().cast("array<string>")).alias("kept"))
    return rows.select(key, F.array_join("kept", "\n").alias(text), F.size("kept").cast("long").alias("n_lines"))


def heading_path(x) -> Column:
    """A heading path from its text: a JSON array, parts split at `` > ``, or a single heading."""
    text = strip(x)
    parts = F.filter(F.transform(F.split(text, " > "), strip), lambda p: p != "")
    return F.when(column(x).isNull() | (text == ""), F.array().cast("array<string>")).when(text.startswith("[") & text.endswith("]") & F.from_json(text, "array<string>").isNotNull(), F.from_json(text, "array<string>")).when(F.instr(text, " > ") > 0, parts).otherwise(F.array(text))


def admitted_documents(df: DataFrame, html_only: bool = False, min_chars: int = 0, kind: str = "content_type", text: str = "text") -> DataFrame:
    ok = F.length(text) >= min_chars
    return df.where(ok & (F.col(kind) == "html") if html_only else ok)
