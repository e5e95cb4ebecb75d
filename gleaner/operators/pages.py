"""HTML pages of the build: elements taken out by selector or attribute rule, body text, cleaned sections.

A page is read once into a small tree by the standard library's parser, inside
Arrow batches; everything else follows from the tree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

from gleaner.functions.text import column, spelled_out
from gleaner.operators.extract import BREAKS, SECTIONS, html_sections_of

# What is taken out of pages by default, where their text is looked for, in which elements, and menu switches.
REMOVED = ("script", "style", "noscript", "nav", "footer")
ROOTS = ("main", "article", "body")
TEXT_TAGS = frozenset(("h1", "h2", "h3", "p", "li", "table"))
NO_NESTING = frozenset(("p", "li", "table"))
SWITCHES = frozenset(("show menu", "hide menu"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    inner: list = field(default_factory=list)  # nodes and strings

    def walk(self, inside: frozenset = frozenset()) -> Iterator[tuple[Node, frozenset]]:
        """Elements below this one in page order, with the tags they lie in."""
        stack = [(x, inside | {self.tag}) for x in reversed(self.inner) if isinstance(x, Node)]
        while stack:
            node, around = stack.pop()
            yield node, around
            stack += [(x, around | {node.tag}) for x in reversed(node.inner) if isinstance(x, Node)]

    def find(self, tag: str) -> Node | None:
        return next((n for n, _ in self.walk() if n.tag == tag), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out += [x.strip()] if x.strip() else []
            elif x.tag not in RAW:
                stack += reversed(x.inner)
        return " ".join(out)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.count: Counter = Counter()

    def handle_starttag(self, tag: str, attrs) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inner.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            while (node := self.open.pop()).tag != tag:
                self.count[node.tag] -= 1
            self.count[tag] -= 1

    def handle_data(self, data: str) -> None:
        self.open[-1].inner.append(data)


def tree(html: str) -> Node:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


@dataclass(frozen=True)
class AttributeRule:
    """Elements whose attribute matches a pattern (case folded), of the given tags or of any."""

    attribute: str
    pattern: str
    tags: tuple[str, ...] = ()

    def takes(self, node: Node) -> bool:
        return (not self.tags or node.tag in self.tags) and self.attribute in node.attrs and re.search(self.pattern, node.attrs[self.attribute], re.I) is not None


_selector = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)\Z")
_condition = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=\"?([^\]\"]*)\"?)?\]")


def selects(selector: str):
    """A test for one simple selector: tag, ``.class``, ``#id``, ``[attribute]``, ``[attribute=value]``, joined."""
    m = _selector.match(selector.strip())
    if not m or not selector.strip():
        raise ValueError(f"selector not supported: {selector}")
    tag, conditions = (m[1] or "*").lower(), _condition.findall(m[2])

    def test(node: Node) -> bool:
        def holds(sign: str, name: str, attribute: str, value: str) -> bool:
            if sign == ".":
                return name in node.attrs.get("class", "").split()
            if sign == "#":
                return node.attrs.get("id") == name
            return attribute in node.attrs and (not value or node.attrs[attribute] == value)

        return tag in ("*", node.tag) and all(holds(*c) for c in conditions)

    return test


def without(root: Node, selectors: tuple[str, ...] = REMOVED, rules: tuple[AttributeRule, ...] = (), tables: bool = True) -> Node:
    """The tree less the elements that a selector or rule takes, and tables where they are not wanted."""
    tests = [selects(s) for s in (*selectors, *(() if tables else ("table",)))] + [r.takes for r in rules]
    for node in [root, *(n for n, _ in root.walk())]:
        node.inner = [x for x in node.inner if isinstance(x, str) or not any(t(x) for t in tests)]
    return root


def body_text(root: Node) -> str:
    """Headings, paragraphs, list items and tables of the main part in order, a line each; rows are lines of cells, nested elements belong to their outermost."""
    top = next((n for n in map(root.find, ROOTS) if n), root)
    parts = []
    for node, around in top.walk():
        if node.tag not in TEXT_TAGS or around & NO_NESTING:
            continue
        if node.tag == "table":
            rows = ([c.text() for c, _ in row.walk() if c.tag in ("td", "th")] for row, _ in node.walk() if row.tag == "tr")
            parts.append("\n\n".join(filter(None, (" | ".join(filter(None, r)) for r in rows))))
        else:
            parts.append(node.text())
    return cleaned("\n".join(filter(None, parts)))


_breaks = re.compile(BREAKS)


def cleaned(text: str) -> str:
    """Addresses and phone numbers written plainly, white space levelled, repeated short lines and menu switches gone."""
    text = re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", spelled_out(text)).replace("\xa0", " ")
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    lines = [x for x in map(str.strip, _breaks.split(text)) if x]
    level = [" ".join(x.split()).lower() for x in lines]
    times = Counter(level)
    return "\n".join(x for x, n in zip(lines, level) if n not in SWITCHES and not (times[n] >= 3 and len(n) <= 80))


def page_of(html: str, selectors: tuple[str, ...] = REMOVED, rules: tuple[AttributeRule, ...] = (), tables: bool = True) -> dict:
    """text and sections of a page; a page without headed sections is one section of its text."""
    sections = html_sections_of(markup(without(tree(html), selectors, rules, tables)))
    text = body_text(without(tree(html), selectors, rules, tables))
    sections = [s | {"content": cleaned(s["content"])} for s in sections]
    if not sections and text:
        sections = [{"heading_path": [], "content": text, "start_char_idx": 0, "end_char_idx": len(text)}]
    return {"text": text, "sections": [s for s in sections if s["content"]]}


def markup(root: Node) -> str:
    """A tree as HTML again."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(f"</{x[0]}>")
        elif isinstance(x, str):
            out.append(x.replace("&", "&amp;").replace("<", "&lt;"))
        else:
            if x.tag:
                attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in x.attrs.items())
                out.append(f"<{x.tag}{attrs}>")
                if x.tag not in VOID:
                    stack.append((x.tag,))
            stack += reversed(x.inner)
    return "".join(out)


def page_document(html, selectors: tuple[str, ...] = REMOVED, rules: tuple[AttributeRule, ...] = (), tables: bool = True) -> Column:
    """struct(text, sections) of pages (Arrow batches)."""
    for s in selectors:
        selects(s)

    def batch(html: pd.Series) -> pd.DataFrame:
        found = [page_of(h or "", selectors, rules, tables) for h in html]
        return pd.DataFrame({"text": [f["text"] for f in found], "sections": [f["sections"] for f in found]})

    return F.pandas_udf(batch, f"text string, sections {SECTIONS}")(column(html))


def needs_ocr(text, least: int = 40) -> Column:
    """Whether a page's own text is too little to do without character recognition."""
    return F.length(F.trim(F.coalesce(column(text), F.lit("")))) < least
