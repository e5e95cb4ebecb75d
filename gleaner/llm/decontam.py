"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all passages of all documents
   (windows of ``WINDOW`` words) give the IDF; words in more than half of the
   passages weigh nothing.
2. A randomised SVD of the TF-IDF matrix of passages (of all documents, and the
   benchmark itself) over the benchmark's words: in the same reading, tasks multiply
   their passages with a random test matrix, tasks add up the products by parts, and
   the driver takes the Nystrom eigendecomposition of the sum.
3. Every passage of every document, at a stride of ``BLOCK`` words, is projected;
   items within cosine ``NEAR`` are candidates.
4. A candidate leaks when the longest common subsequence of words covers
   ``SURE`` of the item, or ``LIKELY`` of it and the answer check holds: the words
   of the item's last sentence that are rarer than ``HEAVY`` (IDF) stand in the
   passage too.

The benchmark is taken in blocks of ``ITEMS`` items, a pass over the documents
each, so what is broadcast is bounded. Words are compared by their letters and
digits in lower case. Null or empty documents and items leak nothing, an item
without words matches nothing, an empty table gives an empty result; a text is
read whole, whatever its length. Of equal (doc_id, item_id) the best row is given,
by common subsequence, then cosine; rows without id are each a document of their own.
Only ``doc_id``, ``text`` and ``item_id`` are read, so further columns do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import fresh, hash_spans, lean, materialize, slices, word_spans

BLOCK, BLOCKS = 16, 3
WINDOW = BLOCK * BLOCKS
RANK, EXTRA = 128, 16
#: Tasks that add up the parts of the range matrix.
PARTS = 16
ITEMS = 1024
NEAR = 0.4
SURE, LIKELY, ANSWER = 0.7, 0.5, 0.75
HEAVY = 3.0
#: Neighbouring windows near one item that are bounded together first.
TOGETHER = 4

_kept = np.zeros(256, np.uint8)
_kept[48:58] = np.arange(48, 58)
_kept[97:123] = np.arange(97, 123)
_kept[65:91] = np.arange(97, 123)
_kept[0x80:] = np.arange(0x80, 256)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice, and each row's first word (n + 1 of them)."""
    starts, ends, words = word_spans(data, offsets)
    plain = _kept[data]
    upper = (data >= 0x80) & (data <= 0x9E)  # after the lead byte C3: capitals
    upper[1:] &= data[:-1] == 0xC3
    upper[:1] = False
    plain[upper & (data != 0x97)] += 0x20
    keep = plain > 0
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    a, b = at[starts], at[ends]
    full = b > a
    count = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=count[1:])
    return hash_spans(plain[keep], a[full], b[full]), count[words]


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]  # word hashes
    answers: list[np.ndarray]  # word hashes of the last sentence
    vocab: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocab & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.numbers = np.searchsorted(self.vocab, np.concatenate(self.words)) if self.words else np.zeros(0, np.int64)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words, and their numbers."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.vocab, hashes[maybe]), max(0, len(self.vocab) - 1))
        ok = self.vocab[pos] == hashes[maybe] if len(self.vocab) else np.zeros(0, bool)
        return maybe[ok], pos[ok]

    def counts(self) -> np.ndarray:
        out = np.zeros((len(self.ids), len(self.vocab)))
        for k, w in enumerate(self.words):
            np.add.at(out[k], self.of(w)[1], 1)
        return out


def read_items(rows) -> Items:
    ids, words, answers = [], [], []
    for id_, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w, _ = tokens(data, np.array([0, len(data)]))
        body = (text or "").rstrip().rstrip(".!?")
        cut = max(body.rfind(c) for c in ".!?\n") + 1
        tail = np.frombuffer(body[cut:].encode(), np.uint8)
        if len(w):
            ids.append(id_)
            words.append(w)
            answers.append(tokens(tail, np.array([0, len(tail)]))[0])
    return Items(ids, words, answers, np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64))


def blocks_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each block of ``BLOCK`` words (blocks end with their row), each block's row, each row's first block (n + 1)."""
    n = -(-np.diff(words) // BLOCK)
    row = np.repeat(np.arange(len(n)), n)
    edge = np.append(0, np.cumsum(n))
    return words[:-1][row] + (np.arange(len(row)) - edge[row]) * BLOCK, row, edge


def test_matrix(n: int) -> np.ndarray:
    return np.random.default_rng(17).normal(size=(n, RANK + EXTRA)).astype(np.float32)


def measured(batches, items: Items):
    """The task's share, in one reading, of (passages^T passages) times the test matrix, cut into ``PARTS``, and of the passages with each word, with the number of passages as the last one (part -1)."""
    omega = test_matrix(len(items.vocab))
    out = np.zeros(omega.shape, np.float64)
    df = np.zeros(len(items.vocab) + 1)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text"), 1 << 16):
            hashes, words = tokens(data, offsets)
            first, row, edge = blocks_of(words)
            if not len(first):
                continue
            place = (np.arange(len(row)) - edge[row]) // BLOCKS  # passages beside each other
            group = np.cumsum(runs(row, place)) - 1
            df[-1] += int(group[-1]) + 1
            at, number = items.of(hashes)
            if not len(at):
                continue
            passage = group[np.searchsorted(first, at, "right") - 1]
            pairs = np.unique(passage * len(items.vocab) + number)
            df[:-1] += np.bincount(pairs % len(items.vocab), minlength=len(items.vocab))
            new = runs(passage)
            z = np.add.reduceat(omega[number], np.flatnonzero(new), axis=0)
            order = np.argsort(number, kind="stable")
            begin = np.flatnonzero(runs(number[order]))
            out[number[order[begin]]] += np.add.reduceat(z[(np.cumsum(new) - 1)[order]], begin, axis=0)
    if df[-1]:
        shares = [df, *np.array_split(out.astype(np.float32), PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, PARTS), pa.int32()), pa.array([x.astype(np.float64 if k == 0 else np.float32).tobytes() for k, x in enumerate(shares)], pa.binary())], names=["part", "y"])


def added(batches):
    """The sums of the tasks' shares by part, as numbers of 64 bit."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("part").to_pylist(), batch.column("y")):
            share = np.frombuffer(x.as_buffer(), np.float64 if k < 0 else np.float32)
            total[k] = total[k] + share if k in total else share.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "y"])


@dataclass
class Latent:
    items: Items
    idf: np.ndarray
    project: np.ndarray  # words x RANK, IDF included
    queries: np.ndarray  # items x RANK, of length 1


def fit(docs: DataFrame, items: Items) -> Latent:
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    omega = test_matrix(len(items.vocab))
    # The tasks' shares are added up one by one, each part in a task of its own; one matrix comes to the driver.
    shares = texts.mapInArrow(lean(lambda it: measured(it, items)), "part int, y binary").repartition(PARTS, "part").mapInArrow(lean(added), "part int, y binary").collect()
    parts = {r.part: np.frombuffer(r.y, np.float64) for r in shares}
    df = parts.pop(-1, np.zeros(len(items.vocab) + 1)).copy()
    y = np.concatenate([parts[k] for k in range(PARTS)]).reshape(omega.shape) if parts else np.zeros(omega.shape)
    own = items.counts()
    df[:-1] += (own > 0).sum(0)
    df, total = df[:-1], df[-1] + len(items.ids)
    idf = np.maximum(0, np.log((total - df + 0.5) / (df + 0.5)))
    # The test matrix stands for D^-1 times another one, so IDF may be applied afterwards.
    live = np.flatnonzero(idf > 0)
    weighted = own[:, live] * idf[live]
    boost = max(1.0, (y[live] ** 2).sum() ** 0.5 / max(1e-9, len(items.ids)))
    test = omega[live] / idf[live, None]
    y = idf[live, None] * y[live] + boost * weighted.T @ (weighted @ test)
    vectors = eigenvectors(y, test, RANK)
    project = np.zeros((len(items.vocab), vectors.shape[1]), np.float32)
    project[live] = idf[live, None] * vectors
    queries = own @ project
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    return Latent(items, idf, project, queries.astype(np.float32))


def eigenvectors(y: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of M from Y = M @ test (single-pass Nystrom, with a stabilising shift)."""
    if not y.size:
        return np.zeros((len(y), 1))
    q, r = np.linalg.qr(test)
    y = y @ np.linalg.pinv(r)
    shift = 1e-7 * np.linalg.norm(y)
    y = y + shift * q
    core = q.T @ y
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    ok = value > 1e-12 * max(value.max(), 1e-300)
    u, s, _ = np.linalg.svd(y @ (vector[:, ok] / np.sqrt(value[ok])), full_matrices=False)
    return u[:, :rank]


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence, bit-parallel over the bits of one integer."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def shared(items: Items, at: np.ndarray, number: np.ndarray, q: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each candidate, how many of the item's words stand anywhere in its region: an upper bound of the common subsequence."""
    base = int(at[-1]) + 2 if len(at) else 1
    place = np.sort(number * base + at)
    n = items.size[q]
    which = np.repeat(items.first[q] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    word = items.numbers[which] * base
    pos = np.searchsorted(place, word + np.repeat(np.minimum(begin, base - 1), n))
    there = place[np.minimum(pos, len(place) - 1)] < word + np.repeat(np.minimum(end, base), n)
    there &= pos < len(place)
    total = np.append(0, np.cumsum(there))
    edge = np.cumsum(n)
    return total[edge] - total[edge - n]


def add_words(sums: np.ndarray, block: np.ndarray, number: np.ndarray, vectors: np.ndarray) -> None:
    """Add to each block's sum the vectors of its words: the first words of all blocks, then the second ones, and so on."""
    begin = np.flatnonzero(runs(block))
    size = np.diff(np.append(begin, len(block)))
    order = np.argsort(-size, kind="stable")
    begin, size, place = begin[order], size[order], block[begin[order]]
    total = np.zeros((len(begin), vectors.shape[1]), vectors.dtype)
    for k in range(int(size[0])):
        n = int(np.searchsorted(-size, -k))  # blocks with more than k words
        total[:n] += vectors[number[begin[:n] + k]]
    sums[place] = total


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


FOUND = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())])


def search(batches, latent: Latent, near: float):
    items = latent.items
    for batch in batches:
        found: dict[tuple, tuple] = {}
        doc_ids, row_ids = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for lo, _, data, offsets in slices(batch.column("text"), 1 << 18):
            hashes, words = tokens(data, offsets)
            first, row, edge = blocks_of(words)
            at, number = items.of(hashes)
            if not len(at):
                continue
            block = np.searchsorted(first, at, "right") - 1
            sums = np.zeros((len(first) + BLOCKS - 1, latent.project.shape[1]), np.float32)
            add_words(sums, block, number, latent.project)
            window = sums[: len(first)].copy()
            for k in range(1, BLOCKS):
                ok = np.append(row, np.full(k, -1))[k : len(row) + k] == row
                window += np.where(ok[:, None], sums[k : len(first) + k], 0)
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            live = np.flatnonzero(norm > 1e-6)
            cos = (window[live] / norm[live, None]) @ latent.queries.T
            w, q = np.nonzero(cos >= near)
            pad = items.size[q] // 2 + 4
            at_row = row[live[w]]
            begin = np.maximum(words[at_row], first[live[w]] - pad)
            end = np.minimum(words[at_row + 1], first[live[w]] + WINDOW + pad)
            # The bound of the regions of neighbouring windows together is no less than that of each.
            order = np.lexsort((begin, at_row, q))
            run = np.arange(len(order)) - np.maximum.accumulate(np.where(runs(q[order], at_row[order]), np.arange(len(order)), 0))
            head = np.flatnonzero(run % TOGETHER == 0)
            some = order[head]
            far = np.maximum.reduceat(end[order], head) if len(head) else end[:0]
            near_enough = np.repeat(shared(items, at, number, q[some], begin[some], far) >= LIKELY * items.size[q[some]], np.diff(np.append(head, len(order))))
            kept = np.sort(order[near_enough])
            w, q, at_row, begin, end = w[kept], q[kept], at_row[kept], begin[kept], end[kept]
            bound = shared(items, at, number, q, begin, end) / items.size[q]
            ok = np.flatnonzero(bound >= LIKELY)
            ok = ok[np.argsort(-cos[w[ok], q[ok]], kind="stable")]  # of equals the nearest is kept
            for w, q, r, s, e, most in zip(*(x[ok].tolist() for x in (w, q, at_row, begin, end, bound))):
                item, region = items.words[q], hashes[s:e]
                key = (doc_ids[lo + r], row_ids[lo + r], items.ids[q])
                if found.get(key, (0, 0))[1] >= most:
                    continue
                ratio = common_length(item, region) / len(item)
                if ratio < LIKELY or found.get(key, (0, 0))[1] >= ratio:
                    continue
                answer = items.answers[q]
                heavy = answer[latent.idf[items.of(answer)[1]] >= HEAVY]
                held = bool(len(heavy)) and float(np.isin(heavy, region).mean()) >= ANSWER
                if ratio >= SURE or held:
                    found[key] = (float(cos[w, q]), ratio, held)
        cols = list(zip(*(k + v for k, v in found.items()))) or [()] * len(FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, FOUND)], schema=FOUND)


def row_leaks(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, row (hash of id and text), item_id, cosine, lcs, answer of every passage found, a row or more for each row of ``docs`` and item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    out = spark.createDataFrame([], "doc_id long, row long, item_id long, cosine double, lcs double, answer boolean")
    rows, block = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator(), []

    def passed(block: list) -> DataFrame:
        items = read_items(block)
        if not items.ids:
            return out
        latent = fit(docs, items)
        return docs.mapInArrow(lean(lambda it: search(it, latent, near)), out.schema)

    for r in rows:
        block.append((r.item_id, r.text))
        if len(block) == ITEMS:
            out = out.unionByName(passed(block))
            block = []
    if block:
        out = out.unionByName(passed(block))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer of every document that holds a benchmark item."""
    best = F.max(F.struct("lcs", "cosine", "answer")).alias("best")
    nameless = F.when(F.col("doc_id").isNull(), F.col("row")).alias("nameless")
    return row_leaks(docs, benchmark, near).groupBy("doc_id", nameless, "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs", "best.answer")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no benchmark item; rows of one id are judged each by itself, a row without id stays."""
    id_, row, bad_id, bad_row = (fresh(docs, c) for c in ("_id", "_row", "_bad_id", "_bad_row"))
    bad = materialize(row_leaks(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias(bad_id), F.col("row").alias(bad_row)).distinct(), "leaked")
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(row, F.xxhash64(id_, F.coalesce("text", F.lit(""))))
    return keyed.join(bad.hint("shuffle_hash"), (F.col(row) == F.col(bad_row)) & (F.col(id_) == F.col(bad_id)), "left_anti").drop(id_, row)
