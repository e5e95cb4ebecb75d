"""Main text of web pages by consensus host paths.

Every page is read into containers (body, div, article, ...) and the blocks of
text in them; subtrees that are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, comments and the like count for nothing. A container
scores by its share of the page's text, less its links, and the deepest of
equals wins. The scores are votes for the container's generalised path (tags and
classes, digits levelled) and are summed by host, map side first. Then every
page is read again and its text taken from the elements at the first of its
host's best paths that holds most of the page's text, else at the first that
holds any, else from the page's own best container.

Furniture is told by its tag (``NEGATIVE_TAGS``), by being hidden, or by the words
of its class and id. A form, or an element named by ``WEAK_WORDS`` alone, is none
where it holds most of the page's text; a weak word beside one of
``CONTENT_WORDS`` (``article-legal``) names a part of the article.

Reading is one pass over the page, linear in its length: a quote that never
closes makes the rest of the page's tags end at their first ``>``, and paths longer than
``PATH_CHARS`` begin with a hash. Blocks keep page order, one line each, white space
inside levelled to one space. Null or empty html gives an empty text; a page of an
unknown host (null url) votes under the host ``''``; repeated rows are extracted as
often as they stand; markup that never closes is closed by what follows, a tag that never
ends is text. Ties between paths go by votes, depth, then the path itself. An empty
table gives an empty result; only ``page_id``, ``url`` and ``html`` are read, so
further columns do not clash.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import materialize

# HTML vocabulary and the words by which page furniture is named.
RAW = "script style title textarea template iframe noscript svg math object canvas video audio select"
VOID = "area base br col embed hr img input link meta param source track wbr"
CONTAINERS = "body div article section main td center aside nav header footer form dialog menu details figure fieldset"
BLOCKS = "address blockquote caption dd dl dt figcaption h1 h2 h3 h4 h5 h6 head html legend li ol optgroup option p pre summary table tbody tfoot th thead tr ul"
SWALLOWING = "script style title textarea template iframe noscript"
NEGATIVE_TAGS = "nav footer aside dialog menu button head"
NEGATIVE_WORDS = "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion comment comments commentlist reply replies respond disqus discussion sidebar side aside nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs footer foot masthead topbar toolbar notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager form search hidden copyright legal disclaimer"
TOP = 3
SHARE = 0.5
#: Votes of a whole page: fine enough that one character tells two containers apart.
VOTE = 1_000_000_000
#: Beside these, a word above names a layout, not furniture.
LAYOUT_WORDS = "has with no without layout wrapper page"
#: Words above that articles are named by as well, and words that say so.
WEAK_WORDS = "search legal copyright disclaimer form social discussion"
CONTENT_WORDS = "article story content post entry main text body"
PATH_CHARS = 400
#: Hosts whose paths are broadcast at most; with more, pages are joined by host.
BROADCAST_HOSTS = 50_000
#: A host with more than one of so many pages is split in the join, so there are no more hot hosts than that.
HOT = 1000

_raw, _void, _containers = frozenset(RAW.split()), frozenset(VOID.split()), frozenset(CONTAINERS.split())
_blocks = frozenset(BLOCKS.split()) | _containers
_negative_tags, _negative = frozenset(NEGATIVE_TAGS.split()), frozenset(NEGATIVE_WORDS.split())
_layout, _weak, _content = (frozenset(w.split()) for w in (LAYOUT_WORDS, WEAK_WORDS, CONTENT_WORDS))
_headings = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_own = frozenset(("body", "article", "main", "html"))
#: A start tag ends open elements of the second set, unless one of the third stands between.
_closes = {
    "li": (frozenset(("li", "p")), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th", "p")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "p")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "p")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
_p_only = frozenset(("p", *_headings))
_name = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_stop = re.compile(r">|=\s*([\"'])")
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _raw}
_swallowing = frozenset(SWALLOWING.split())
_class = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_id = re.compile(r"(?:^|\s)(?:id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_hidden = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_words = re.compile(r"[a-z]+")
_digits = re.compile(r"\d+")


def tags(html: str):
    """(text before, tag, whether it closes, attributes) of each tag, in order; the last has the rest of the text and no tag.

    Comments, declarations and the contents of ``RAW`` elements are passed over.
    """
    n, begin, pos = len(html), 0, 0
    last = html.rfind(">")
    loose = False  # a quote never closes: quotes count no more
    parts: list[str] = []
    unclosed: set[str] = set()
    while (at := html.find("<", pos)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            parts.append(html[begin:at])
            begin = pos = n if end < 0 else end + 3
            continue
        if at > last:
            break
        if html.startswith(("<!", "<?"), at):
            parts.append(html[begin:at])
            begin = pos = html.index(">", at) + 1
            continue
        m = _name.match(html, at)
        if not m:
            pos = at + 1
            continue
        end, look = -1, m.end()
        while not loose:
            stop = _stop.search(html, look)
            if stop is None:
                loose = True
            elif stop[1] is None:
                end = stop.start()
                break
            elif (look := html.find(stop[1], stop.end()) + 1) == 0:
                loose = True
        if loose:
            end = html.find(">", m.end())
        if end < 0:
            break
        tag, closes, attrs = m[2].lower(), bool(m[1]), html[m.end() : end]
        if tag in _raw:
            parts.append(html[begin:at])
            begin = pos = end + 1
            empty = tag not in _swallowing and attrs.rstrip().endswith("/")
            if closes or empty or tag in unclosed:
                continue
            if stop := _raw_end[tag].search(html, pos):
                close = html.find(">", stop.end())
                begin = pos = n if close < 0 else close + 1
            elif tag in _swallowing:
                begin = pos = n
            else:
                unclosed.add(tag)
            continue
        parts.append(html[begin:at])
        yield "".join(parts), tag, closes, attrs
        parts.clear()
        begin = pos = end + 1
    parts.append(html[begin:])
    yield "".join(parts), "", False, ""


def step_of(tag: str, classes: list[str]) -> str:
    step = ".".join([tag, *sorted({_digits.sub("#", c) for c in classes})])
    return step if len(step) <= PATH_CHARS else f"{tag}.{xxhash.xxh64_hexdigest(step)}"


def path_of(parent: str, step: str) -> str:
    return f"{parent if len(parent) <= PATH_CHARS else '#' + xxhash.xxh64_hexdigest(parent)}>{step}"


def furniture(tag: str, attrs: str) -> tuple[int, bool, list[str]]:
    """How far an element is furniture (0 not, 1 unless it holds most of the page, 2 surely), whether it is a header, and its classes."""
    classes: list[str] = []
    kind, header = 2 if tag in _negative_tags else 1 if tag == "form" else 0, tag == "header"
    if attrs:
        if c := _class.search(attrs):
            classes = (c[1] or c[2] or c[3] or "").lower().split()
        named = set(_words.findall(" ".join(classes)))
        for c in _id.finditer(attrs):
            named |= set(_words.findall((c[1] or c[2] or c[3] or "").lower()))
        if tag not in _own:
            bad = named & _negative
            if _hidden.search(attrs) or (bad - _weak and not named & _layout):
                kind = 2
            elif bad and not named & _layout and not named & _content:
                kind = max(kind, 1)
            header = header or ("header" in named and tag not in _headings)
    return kind, header, classes


def read(html: str) -> tuple[list[tuple[str, int]], list[tuple[int, str, int]]]:
    """Containers (path, parent) and blocks (container, text, characters in links), in page order."""
    containers: list[tuple[str, int]] = [("body", -1)]
    found: list[tuple[int, str, int, int]] = []  # and the furniture it is in, 0 for none
    # Tag, container, furniture (-1 for sure), whether in a header of the article.
    stack: list[tuple[str, int, int, bool]] = [("html", 0, 0, False)]
    open_: Counter = Counter(("html",))
    buffer: list[str] = []
    linked = 0
    link = False
    doubtful = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            tag, at, out, header = stack[-1]
            if out >= 0 and (not header or tag in _headings):
                text = " ".join(unescape("".join(buffer)).split())
                if text:
                    found.append((at, text, linked, out))
            buffer.clear()
        linked = 0

    def cut(k: int) -> None:
        for t in stack[k:]:
            open_[t[0]] -= 1
        del stack[k:]

    def push(tag: str, at: int, out: int, header: bool) -> None:
        stack.append((tag, at, out, header))
        open_[tag] += 1

    for text, tag, closes, attrs in tags(html):
        if text:
            buffer.append(text)
            if link:
                linked += len(text)
        if tag in _void:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag not in _blocks:
            if tag == "a":
                link = not closes
            elif tag == "button":
                flush()
                if not closes:
                    push(tag, stack[-1][1], -1, False)
                elif stack[-1][0] == tag:
                    cut(len(stack) - 1)
            continue
        flush()
        link = False
        if closes:
            if open_[tag] and tag != "html":
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                cut(max(k, 1))
            continue
        if stack[-1][0] == "head":
            cut(len(stack) - 1)
        shut, stop = _closes.get(tag, (_p_only, _containers))
        if any(open_[t] for t in shut):
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name in shut:
                    cut(k)
                    break
                if name in stop or name in _containers:
                    break
        if tag == "body":
            cut(1)
            push(tag, 0, 0, False)
            continue
        _, at, out, in_header = stack[-1]
        kind, header, classes = furniture(tag, attrs)
        if header:
            if open_["article"] or open_["main"]:
                in_header = True
            else:
                kind = 2
        if kind == 2:
            out = -1
        elif kind == 1 and out >= 0:
            doubtful += 1
            out = doubtful
        if tag in _containers:
            containers.append((path_of(containers[at][0], step_of(tag, classes)), at))
            at = len(containers) - 1
        push(tag, at, out, in_header)
    flush()
    size = [0] * (doubtful + 1)
    for _, text, linked, out in found:
        size[out] += len(text) - min(linked, len(text))
    largest = max(range(doubtful + 1), key=size.__getitem__)
    page = largest if 2 * size[largest] > sum(size) else 0
    return containers, [f[:3] for f in found if f[3] in (0, page)]


def scores(containers, blocks) -> list[float]:
    """By container: its share of the text, less links."""
    good, links = [0] * len(containers), [0] * len(containers)
    for at, text, linked in blocks:
        good[at] += len(text)
        links[at] += min(linked, len(text))
    for k in range(len(containers) - 1, 0, -1):
        good[containers[k][1]] += good[k]
        links[containers[k][1]] += links[k]
    total = max(1, good[0] - links[0])
    return [(g - n) / total - 0.3 * (n / g if g else 0) for g, n in zip(good, links)]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())])


def votes_of(batches):
    votes: Counter = Counter()
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            containers, blocks = read(html or "")
            if blocks:
                best: dict[str, float] = {}
                for (path, _), score in zip(containers, scores(containers, blocks)):
                    best[path] = max(score, best.get(path, 0))
                for path, score in best.items():
                    if score >= SHARE:
                        votes[host, path] += round(VOTE * score)
        if len(votes) > 100_000:
            yield give(votes)
            votes.clear()
    yield give(votes)


def give(votes: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], schema=VOTES)


def main_text(html: str, paths: list[str]) -> str:
    containers, blocks = read(html)
    if not blocks:
        return ""
    chosen: set[int] = set()
    known = {c[0] for c in containers}
    size = [len(text) - min(linked, len(text)) for _, text, linked in blocks]
    for path in paths:
        if path in known:
            here = {k for k, c in enumerate(containers) if c[0] == path}
            within = inside(containers, here)
            held = [within[at] for at, _, _ in blocks]
            if sum(n for n, h in zip(size, held) if h) > SHARE * sum(size):
                chosen = here
                break
            if any(held) and not chosen:
                chosen = here
    if not chosen:
        best = scores(containers, blocks)
        # With no path of the host to go by, a little more for depth.
        depth = [0] * len(containers)
        for k in range(1, len(containers)):
            depth[k] = min(20, depth[containers[k][1]] + 1)
        chosen = {max(range(len(best)), key=lambda k: (best[k] + 0.01 * depth[k], -k))}
    within = inside(containers, chosen)
    return "\n".join(text for at, text, _ in blocks if within[at])


def inside(containers, chosen: set[int]) -> list[bool]:
    """Which containers are a chosen one or lie in one; parents come before children."""
    within = [False] * len(containers)
    for k, (_, parent) in enumerate(containers):
        within[k] = k in chosen or (parent >= 0 and within[parent])
    return within


def texts_of(batches):
    for batch in batches:
        texts = [main_text(h or "", p or []) for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the host's ``TOP`` paths, most votes first."""
    votes = pages.select(host_of("url").alias("host"), "html").mapInArrow(votes_of, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.size(F.split("path", ">"))), "path"))
    top = votes.withColumn("rank", rank).where(F.col("rank") <= TOP)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def with_paths(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """``pages`` with their host's paths; html moves only where there are too many hosts to broadcast, and then no host is a hot key."""
    paths = materialize(paths, "host-paths")
    if paths.count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(paths), "host", "left")
    of_host = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(of_host.crossJoin(F.broadcast(of_host.agg(F.sum("n").alias("all")))).where(F.col("n") * HOT > F.col("all")).select("host", F.ceil(F.col("n") * HOT / F.col("all")).cast("int").alias("copies")), "hot-hosts")
    copies = F.coalesce("copies", F.lit(1))
    spread = pages.join(F.broadcast(hot), "host", "left").withColumn("copy", F.pmod(F.xxhash64("page_id", "url"), copies).cast("int")).drop("copies")
    many = paths.join(F.broadcast(hot), "host", "left").select("host", "paths", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    return spread.join(many, ["host", "copy"], "left")


def extract_main(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of("url").alias("host"))
    return with_paths(pages, winning_paths(pages)).select("page_id", "url", "html", "paths").mapInArrow(texts_of, "page_id long, url string, text string, n_chars long")
