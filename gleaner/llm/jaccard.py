"""Exact n-gram Jaccard self-join by parity sketches.

A document's set holds its distinct 5-word shingles (64-bit hashes). Its parity
sketch for a size band [s/2, s) has P parts; every shingle flips, by XOR, bits
of one part chosen by its hash. A shingle of the symmetric difference changes
one part at most, so the number of differing parts is a lower bound of the
symmetric difference, and documents with J >= 0.8 differ in at most
(|A| + |B|) / 9 shingles. With P above that bound at least one part must be
equal (pigeonhole), and P leaves room for parts that are empty on both sides,
which are not joined. A document goes into its own band, and also into the next
when a partner 1.25 times its size can be there.

Exact copies are one class and take part once a task. Equal parts are joined by
hash and counted by pair and band: by the bound above, a linked pair has so and
so many equal parts, and pairs with fewer are dropped before any text is fetched.
Parts shared by more than ``CROWD`` classes are *crowded*: there all are
compared with the smallest class only. The rows of the meeting tell how many
crowded parts a class has in a band; with fewer than a linked pair shares, it
must share a calm part with each partner, so nothing is lost. Nor is anything lost
in a crowded part whose classes are all connected already. What is left (classes
mostly made of crowded, unconnected parts) is joined again with each shingle as a part. What
that leaves is compared with the most typical class of each part, and what is still
open pair by pair, but only in the rarest parts of either class that a linked pair
cannot do without: few, since near copies that do not link differ in parts of their own.
Candidates are verified on whole texts; links are exact up to 64-bit collisions.
Connected components come from min-label propagation with pointer jumping over
the links, each round written to the shared folder.

Null texts and texts without words have no shingles and no links; a text with
fewer than five words is one shingle of all its words. Repeated rows give equal
results as often as they stand; rows of one doc_id whose texts differ are
separate rows; a null doc_id is a row without id, and null is the component of
a group without any id. Order and ties decide nothing but the kept row of
``keep_one``, the first by id, then by hash of the text. An empty table gives an
empty result. Only ``doc_id`` and ``text`` are read, so further columns do not clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import LOWER, fresh, hash_spans, lean, materialize, mix, powers, slices, word_spans

SHINGLE = 5
SIMILAR, OF = 80, 100
CROWD = 12
#: Parts a shingle of the band's largest size: the first sketch, and the finer one for classes in doubt; infinite: every shingle is a part of its own.
FINENESS = (0.32, math.inf)
#: Pairs that one copy of a class's text serves.
PAIRS_A_COPY = 64
#: Shingles of texts that a verifying task keeps at hand.
CACHED = 1 << 21
#: Links whose components one task finds.
ONE_TASK = 1 << 19
#: Copies of the fewer side where what is left is compared.
SALTS = 16
TAG_BITS = 28
MET = "a long, b long, band int, need int, key long, room int, size int"
MET_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("band", pa.int32()), ("need", pa.int32()), ("key", pa.int64()), ("room", pa.int32()), ("size", pa.int32())])
U64 = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    starts, ends, words = word_spans(data, offsets)
    keys = hash_spans(LOWER[data], starts, ends)
    up, down = powers(len(keys) + 1)
    total = np.zeros(len(keys) + 1, U64)
    np.cumsum(keys * up[:-1], out=total[1:])
    full = mix((total[SHINGLE:] - total[:-SHINGLE]) * down[: max(0, len(keys) + 1 - SHINGLE)]) if len(keys) >= SHINGLE else np.zeros(0, U64)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((total[b : b + 1] - total[a : a + 1]) * down[a : a + 1] + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """Same for equal sets; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        h = mix(np.array([np.add.reduce(mix(s ^ U64(0xA5A5A5A5A5A5A5A5))) ^ U64(len(s))], U64))
    return int(h.view(np.int64)[0]) or 1


def bands(n: int) -> list[int]:
    """Exponents b of the bands [2**(b-1), 2**b) that a set of n shingles takes part in."""
    b = n.bit_length()
    return [b, b + 1] if n * OF >= SIMILAR << b else [b]


def parts_of(band: int, fineness: float) -> int:
    return max(8, math.ceil(fineness * (1 << band)))


def sketch(s: np.ndarray, band: int, fineness: float) -> tuple[np.ndarray, int]:
    """Keys of the parts to join on, and how many parts are not empty."""
    if math.isinf(fineness):
        return mix(s ^ U64(0x5E7)), len(s)
    parts = parts_of(band, fineness)
    seed = U64((band * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64) ^ round(fineness * 1000))
    h = mix(s ^ seed)
    part = ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, h = part[order], h[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    parity = np.bitwise_xor.reduceat(mix(h), first)
    keys = mix(parity ^ mix(part[first].astype(U64) + seed))
    if len(first) <= (len(s) + largest_partner(len(s), band)) // 9:
        # Too many empty parts for the bound: join on them as well. A partner in the same case does so too.
        missing = np.setdiff1d(np.arange(parts), part)
        keys = np.concatenate([keys, mix(mix(missing.astype(U64) + seed) ^ U64(0xEEEE))])
    return keys, len(first)


def largest_partner(n: int, band: int) -> int:
    return min(5 * n // 4, (1 << band) - 1)


@dataclass(frozen=True)
class Least:
    """How many parts classes that link share at least. ``room``: a sketch's parts that are not empty; ``size``: of the set."""

    whole: bool  # every shingle is a part

    def pair(self, a: tuple, b: tuple) -> int:
        """Of two classes (fp, size, room, band)."""
        return (4 * (a[1] + b[1]) + 8) // 9 if self.whole else max(a[2], b[2]) - (a[1] + b[1]) // 9

    def of_pair(self, size_a: Column, room_a: Column, size_b: Column, room_b: Column) -> Column:
        return F.ceil(4 * (size_a + size_b) / 9) if self.whole else F.greatest(room_a, room_b) - F.floor((size_a + size_b) / 9)

    def as_small(self) -> Column:
        """With any partner no smaller than itself."""
        size = F.col("size")
        largest = F.least(F.floor(5 * size / 4), F.expr("shiftleft(1, band) - 1"))
        return F.greatest(F.lit(1), F.ceil(8 * size / 9) if self.whole else F.col("room") - F.floor((size + largest) / 9)).cast("int")

    def as_large(self) -> Column:
        """With any partner no larger than itself."""
        size = F.col("size")
        return F.greatest(F.lit(1), F.ceil(4 * size / 5) if self.whole else F.col("room") - F.floor(2 * size / 9)).cast("int")


def scan(batches):
    """Fingerprint and set size of each row."""
    for batch in batches:
        n, fp = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, offsets in slices(batch.column("text")):
            for i, s in zip(range(lo, hi), shingle_sets(data, offsets)):
                n[i], fp[i] = len(s), fingerprint(s)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fp), pa.array(n)], names=["doc_id", "row", "fp", "n_shingles"])


def keys_of(batches, fineness: float):
    """(key, fp, tag) of the sketch parts; the tag holds the band, the set's size and the room (see ``Least``). A task gives each class once, as far as it remembers."""
    seen: set[int] = set()
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            keys, fps, tags = [], [], []
            for s in shingle_sets(data, offsets):
                fp = fingerprint(s)
                if not fp or fp in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(fp)
                for band in [0] if math.isinf(fineness) else bands(len(s)):
                    k, room = sketch(s, band, fineness)
                    keys.append(k)
                    fps.append(np.full(len(k), fp, np.int64))
                    tags.append(np.full(len(k), band << 2 * TAG_BITS | len(s) << TAG_BITS | room, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(tags))], names=["key", "fp", "tag"])


def meetings(batches, crowd: int, least: Least):
    """From (key, fp, tag) sorted: pairs of classes that share a key, (a, b, band, need; key, room, size).

    ``need``: how many parts the two share at least if they link. Up to ``crowd``
    classes meet pairwise, the other columns null. A crowded key pairs each class
    with the smallest, in one row a class (the smallest with itself) that holds the
    key and the class's own room and size. Rows are given as they come, no group is
    held beyond ``crowd`` classes.
    """
    key_now, members, crowded, last = None, [], False, None
    out: list[tuple] = []

    def pair(a, b, key=None):
        if key is not None:
            out.append((a[0], b[0], b[3], least.pair(a, b), key, b[2], b[1]))
        elif min(a[1], b[1]) * OF >= SIMILAR * max(a[1], b[1]):
            out.append((a[0], b[0], b[3], least.pair(a, b), None, None, None))

    def close():
        if not crowded:
            for j in range(len(members)):
                for i in range(j):
                    pair(members[i], members[j])

    def give():
        cols = list(zip(*out)) if out else [[] for _ in MET_SCHEMA]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MET_SCHEMA)], schema=MET_SCHEMA)

    for batch in batches:
        key, fp, tag = (batch.column(c).to_numpy() for c in ("key", "fp", "tag"))
        if not len(key):
            continue
        # Keys of a single class, which nearly all are, are passed over at once.
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        shared = same[:-1] | same[1:]
        shared[-1] = True
        shared[0] = True
        key, fp, tag = key[shared], fp[shared], tag[shared]
        band, size, room = tag >> 2 * TAG_BITS, tag >> TAG_BITS & (1 << TAG_BITS) - 1, tag & (1 << TAG_BITS) - 1
        for k, *own in zip(*(x.tolist() for x in (key, fp, size, room, band))):
            if k != key_now:
                close()
                key_now, members, crowded, last = k, [], False, None
            if own[0] == last:
                continue
            last = own[0]
            if crowded:
                pair(members[0], own, k)
                if len(out) >= 1 << 16:
                    yield give()
            else:
                members.append(own)
                if len(members) > crowd:
                    crowded = True
                    for m in members:
                        pair(members[0], m, k)
                    members = members[:1]
        yield give()
    close()
    yield give()


def verified(batches):
    """Pairs of texts that link."""
    sets: dict[int, np.ndarray] = {}
    held = 0

    def set_of(fp: int, text) -> np.ndarray:
        nonlocal held
        if fp not in sets:
            if held > CACHED:
                sets.clear()
                held = 0
            sets[fp] = one_set(text.as_py())
            held += len(sets[fp])
        return sets[fp]

    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        a, b, a_text, b_text = (batch.column(c) for c in ("a", "b", "a_text", "b_text"))
        for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
            a_set, b_set = set_of(x, a_text[i]), set_of(y, b_text[i])
            small, large = sorted((len(a_set), len(b_set)))
            if small * OF >= SIMILAR * large:
                common = len(np.intersect1d(a_set, b_set, assume_unique=True))
                ok[i] = common * OF >= SIMILAR * (len(a_set) + len(b_set) - common)
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def one_set(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]))[0]


def meet(docs: DataFrame, fineness: float, crowd: int, name: str) -> DataFrame:
    keys = docs.select("text").mapInArrow(lean(lambda it: keys_of(it, fineness)), "key long, fp long, tag long")
    least = Least(math.isinf(fineness))
    return materialize(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(lambda it: meetings(it, crowd, least)), MET), name)


def plausible(met: DataFrame, crowds: DataFrame) -> DataFrame:
    """Pairs with enough equal parts: as many as a linked pair has in the band, less those that may be hidden in crowded parts."""
    pairs = met.where("a != b").groupBy("a", "b", "band").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    for side in "ab":
        pairs = pairs.join(crowds.select(F.col("fp").alias(side), "band", F.col("crowded").alias(f"c_{side}")), [side, "band"], "left")
    hidden = F.least(F.coalesce("c_a", F.lit(0)), F.coalesce("c_b", F.lit(0)))
    return pairs.where(F.col("n") >= F.greatest(F.lit(1), F.col("need") - hidden)).select("a", "b")


def texts_of(fps: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """fp, text of some classes: one document each."""
    rows = classes.join(fps, "fp", "left_semi").select("row", "fp")
    return materialize(docs.select("row", "text").join(rows.hint("shuffle_hash"), "row").dropDuplicates(["fp"]).select("fp", "text"), "class-texts")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The linked ones of pairs of classes.

    A class that many others are compared with has its text copied once for
    ``PAIRS_A_COPY`` pairs, and copies are joined under keys of their own, so none is a hot key.
    """
    pairs = materialize(pairs.where("a != b").select("a", "b").distinct(), "pairs")
    copies = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_COPY).cast("int").alias("copies"))
    copies = materialize(copies, "copies")
    many = copies.where("copies > 1")
    found = texts_of(copies.select("fp"), docs, classes)
    found = found.join(many, "fp", "left").select("fp", "text", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    for side, other in ("ab", "ba"):
        own = pairs.join(many.withColumnRenamed("fp", side), side, "left")
        own = own.withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        pairs = own.join(found.select(F.col("fp").alias(side), F.col("text").alias(f"{side}_text"), "copy"), [side, "copy"]).drop("copy")
    return materialize(pairs.select("a", "b", "a_text", "b_text").mapInArrow(verified, "a long, b long"), "links")


def joined_sets(batches):
    """fp, label of all links of one task, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], names=["fp", "label"])


def components(links: DataFrame) -> DataFrame:
    """fp, label: the smallest class reachable, for every class that has a link.

    Up to ``ONE_TASK`` links are joined by a single task; more by propagation of labels.
    """
    if links.count() <= ONE_TASK:
        return materialize(links.select("a", "b").coalesce(1).mapInArrow(joined_sets, "fp long, label long"), "labels")
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(edges.groupBy(F.col("a").alias("fp")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        # The smallest label among neighbours, then the label's own label.
        near = edges.join(labels.select(F.col("fp").alias("b"), "label"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "fp").select("fp", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("fp").alias("label"), F.col("label").alias("further"))
        nxt = materialize(stepped.join(jump, "label", "left").select("fp", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if not nxt.where("label != was").limit(1).count():
            return nxt.select("fp", "label")
        labels = nxt.select("fp", "label")


def open_rows(rows: DataFrame, links: DataFrame, least: Least) -> DataFrame:
    """The rows (key, fp, band, room, size) that may hide a link, with a label, ``n``, and whether as the smaller or the larger class.

    Classes that link share so and so many parts. If no calm part is among them, all
    are crowded and hold classes not connected yet; so a class with fewer such
    parts hides nothing, nor does a part without a smaller and a larger class.
    """
    rows = rows.join(components(links), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    own = rows.groupBy("fp", "band").agg(F.count(F.lit(1)).alias("n"), F.first("room").alias("room"), F.first("size").alias("size"))
    own = own.select("fp", "band", "n", (F.col("n") >= least.as_small()).alias("small"), (F.col("n") >= least.as_large()).alias("large")).where("small or large")
    rows = rows.join(own, ["fp", "band"])
    some = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("small").alias("s"), F.max("large").alias("l")).where("lo != hi and s and l").select("key")
    return materialize(rows.join(some, "key", "left_semi"), "open")


def first_shared(rest: DataFrame, shared: Column) -> DataFrame:
    """The rows of ``rest`` in which every link shows, given that a class shares so many of its parts at least.

    In one order of all parts, the first part a pair shares stands before either
    class's last ``shared`` - 1. Rare parts come first, so the rows kept are those of small groups.
    """
    own = Window.partitionBy("fp", "band").orderBy("classes", "key")  # no more rows than a sketch has parts
    return rest.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= F.col("n") - shared + 1).drop("nth")


def all_met(rest: DataFrame, links: DataFrame, docs: DataFrame, classes: DataFrame, least: Least) -> DataFrame:
    """``links`` and those among the rows of ``rest``: first with each part's most typical class, then each larger class with the smaller ones by the rarest parts."""
    typical = rest.groupBy("key").agg(F.max_by(F.struct("fp", "label"), F.struct("n", "fp")).alias("t")).select("key", F.col("t.fp").alias("c"), F.col("t.label").alias("c_label"))
    star = rest.join(typical, "key").where("label != c_label").select(F.least("fp", "c").alias("a"), F.greatest("fp", "c").alias("b"))
    links = materialize(links.unionByName(verify(star, docs, classes)), "links")
    rest = open_rows(rest.select("key", "fp", "band", "room", "size"), links, least)
    if rest.isEmpty():
        return links
    rest = rest.join(rest.groupBy("key").agg(F.count(F.lit(1)).alias("classes")), "key")
    rest = materialize(rest.join(rest.groupBy("fp", "band").agg(F.count(F.lit(1)).alias("now")), ["fp", "band"]).drop("n").withColumnRenamed("now", "n"), "rest")
    large = first_shared(rest.where("large"), least.as_large()).select("key", *(F.col(c).alias(f"c_{c}") for c in ("fp", "label", "size", "room", "n")), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    small = first_shared(rest.where("small"), least.as_small()).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    c = F.col
    in_order = (c("size") < c("c_size")) | ((c("size") == c("c_size")) & (c("fp") < c("c_fp")))
    enough = F.least("n", "c_n") >= least.of_pair(c("size"), c("room"), c("c_size"), c("c_room"))
    met = small.join(large, ["key", "salt"]).where((c("label") != c("c_label")) & in_order & (c("size") * OF >= c("c_size") * SIMILAR) & enough)
    more = verify(met.select(F.least("fp", "c_fp").alias("a"), F.greatest("fp", "c_fp").alias("b")), docs, classes)
    return materialize(links.unionByName(more), "links")


def link_classes(docs: DataFrame, classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """fp, label of all classes that have links. ``docs``: row, text; ``classes``: fp and the row of a document."""
    links, subset, rest, least = None, docs, None, None
    for fineness in FINENESS:
        least = Least(math.isinf(fineness))
        met = meet(subset, fineness, crowd, "meetings")
        crowded = met.where("key is not null").select("key", F.col("b").alias("fp"), "band", "room", "size")
        crowds = materialize(crowded.groupBy("fp", "band").agg(F.count(F.lit(1)).alias("crowded"), F.first("room").alias("room"), F.first("size").alias("size")), "crowds")
        found = verify(plausible(met, crowds), subset, classes)
        links = found if links is None else materialize(links.unionByName(found), "links")
        few = crowds.where(F.col("crowded") >= F.least(least.as_small(), least.as_large())).select("fp", "band")
        rest = open_rows(materialize(crowded.join(few, ["fp", "band"], "left_semi"), "crowded"), links, least)
        if rest.isEmpty():
            return components(links)
        subset = texts_of(rest.select("fp").distinct(), subset, classes).join(classes.select("fp", "row"), "fp").select("row", "text")
        subset = materialize(subset, "doubtful-texts")
    return components(all_met(rest, links, subset, classes, least))


def row_components(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles, component_id and kept (the row of the group's first document) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    rows = materialize(docs.mapInArrow(lean(scan), "doc_id long, row long, fp long, n_shingles long"), "sets")
    # A group's first document is the first that has an id.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row")))
    classes = rows.where("fp != 0").groupBy("fp").agg(first.alias("first"), F.min("row").alias("row"))
    classes = materialize(classes, "classes")
    labels = link_classes(docs.select("row", "text"), classes.select("fp", "row"), crowd)
    named = classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("first"))
    of_class = materialize(named.select("fp", "label").join(smallest, "label").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("kept")), "class-components")
    alone = rows.where("fp = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("kept"))
    return rows.where("fp != 0").join(of_class, "fp").select("doc_id", "row", "n_shingles", "component_id", "kept").unionByName(alone)


def similarity_components(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    return row_components(docs, crowd).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs``, all columns, without those of a group but its first: the smallest id, of equal ids the smallest hash.

    Rows without shingles or id stay, and so do all rows equal to the kept one in
    id and text. Other rows of a dropped row's id are not touched.
    """
    id_, row, drop_id, drop = (fresh(docs, c) for c in ("_id", "_row", "_drop_id", "_drop"))
    dropped = row_components(docs, crowd).where("doc_id is not null and (doc_id != component_id or row != kept)")
    dropped = materialize(dropped.select(F.col("doc_id").alias(drop_id), F.col("row").alias(drop)).distinct(), "dropped")
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(row, F.xxhash64(id_, F.coalesce("text", F.lit(""))))
    return keyed.join(dropped.hint("shuffle_hash"), (F.col(row) == F.col(drop)) & (F.col(id_) == F.col(drop_id)), "left_anti").drop(id_, row)
