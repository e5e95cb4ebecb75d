"""Exact BM25 top-k over sharded inverted indexes with block-max pruning.

Index: tasks turn their rows into shards of about ``SHARD_BYTES`` of text, one
row of binary columns each: sorted term hashes, postings (document, tf), lengths.
Documents of a shard are ordered by their most frequent word and length, so
that blocks of ``BLOCK`` documents are alike. Nothing is shuffled to build it.

Search: queries go out in blocks of at most ``QUERY_TERMS`` terms, which bounds
what is broadcast. One pass sums the document frequencies of the block's terms
over all shards; with them, the number of documents and the mean length, all
global, a second pass scores by block-max WAND: posting lists are in document order
and cut into blocks of two sizes (see ``Shard``) that know their largest impact, and
the sum over a document's blocks bounds its score. Documents whose bound reaches the
threshold are the pivots; long blocks without a pivot are never read. Pivots are found
and scored by array operations, a number of documents at a time, and the threshold,
the k-th score so far, rises with each step and carries over a task's shards.
The tasks' best are merged by a window, so the result is that of scoring everything.

score = sum over terms of qtf * ln(1 + (N - n + .5) / (n + .5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)).
Only documents with a query term are results; ties go to the smaller doc_id, after
rounding to 6 decimals. Null or empty texts match nothing; rows with equal ids are
separate documents and separate queries; a null id comes before all others. Texts
count whole, however long; an empty table gives an empty result. Only the id and
``text`` are read, so further columns do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import materialize, slices
from gleaner.llm.decontam import tokens

K1, B = 1.2, 0.75
SHARD_BYTES, SHARD_DOCS = 12 << 20, 1 << 15
BLOCK = 32
#: Lists of this part of a shard's documents have blocks of ``BLOCK`` documents.
LONG = 1 / 8
QUERY_TERMS = 2 << 20
TOP = 10

SHARD = "ids array<long>, lens binary, terms binary, counts binary, docs binary, tfs binary"
SHARD_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("lens", "terms", "counts", "docs", "tfs"))])


def shards_of(batches):
    ids: list = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal size
        lens = np.concatenate([n for _, n in held])
        term = np.concatenate([t for t, _ in held])
        doc = np.repeat(np.arange(len(lens)), lens)
        order = np.argsort(term, kind="stable")
        term, doc = term[order], doc[order]
        new = np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))[: len(term)]
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(term)))
        term, doc = term[at], doc[at]
        # Most frequent word, then length.
        best = np.lexsort((term, -tf, doc))
        head = best[np.append(True, doc[best][1:] != doc[best][:-1])[: len(best)]]
        top = np.zeros(len(lens), np.uint64)
        top[doc[head]] = term[head]
        place = np.lexsort((lens, top))
        rank = np.empty(len(lens), np.int64)
        rank[place] = np.arange(len(lens))
        begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        row = [[ids[i] for i in place], lens[place].astype(np.int32).tobytes(), term[begin].tobytes(), np.diff(np.append(begin, len(term))).astype(np.int32).tobytes(), rank[doc].astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()]
        ids.clear()
        held.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SHARD_SCHEMA)], schema=SHARD_SCHEMA)

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for lo, hi, data, offsets in slices(batch.column("text")):
            hashes, words = tokens(data, offsets)
            held.append((hashes, np.diff(words)))
            ids.extend(doc_ids[lo:hi])
            size += len(data)
            if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                yield flush()
    if ids:
        yield flush()


def vectors_of(batches):
    """Query rows: distinct terms and their counts."""
    for batch in batches:
        terms, counts = [], []
        for _, _, data, offsets in slices(batch.column("text")):
            hashes, words = tokens(data, offsets)
            for a, b in zip(words[:-1], words[1:]):
                t, n = np.unique(hashes[a:b], return_counts=True)
                terms.append(t.tobytes())
                counts.append(n.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["query_id", "terms", "counts"])


@dataclass
class Queries:
    """A block of queries over its own vocabulary."""

    ids: list
    vocab: np.ndarray
    terms: list[np.ndarray]  # numbers in the vocabulary
    weights: list[np.ndarray]
    n_docs: int = 0
    mean: float = 1.0


def df_of(batches, vocab: np.ndarray):
    """(term number, documents), and as terms -1 and -2 the documents and their words."""
    df, n, words = np.zeros(len(vocab), np.int64), 0, 0
    for batch in batches:
        for lens, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("lens", "terms", "counts"))):
            lens, terms, counts = np.frombuffer(lens, np.int32), np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32)
            n += len(lens)
            words += int(lens.sum())
            if len(terms):
                pos = np.minimum(np.searchsorted(terms, vocab), len(terms) - 1)
                df += np.where(terms[pos] == vocab, counts[pos], 0)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [n, words]]))], names=["term", "n"])


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. for count[0] places, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. for count[0] places, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Shard:
    """Posting lists of a shard in document order, in blocks with the largest impact of each.

    Blocks have two sizes. A list of an eighth of the documents or more is cut at
    every ``BLOCK`` documents; its blocks lie side by side with those of other such lists, as columns. A
    shorter list has blocks of one posting, whose largest impact is the posting's.
    """

    def __init__(self, row: dict, vocab: np.ndarray, mean: float):
        self.ids = row["ids"]
        lens, terms, counts = np.frombuffer(row["lens"], np.int32), np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32)
        docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
        self.n = len(lens)
        # Only the query block's terms are kept.
        pos = np.minimum(np.searchsorted(terms, vocab), max(0, len(terms) - 1))
        there = np.flatnonzero(terms[pos] == vocab) if len(terms) else np.zeros(0, np.int64)
        count = counts[pos[there]].astype(np.int64)
        take = ranges((np.cumsum(counts) - counts)[pos[there]].astype(np.int64), count)
        self.docs = docs[take]
        tf = tfs[take].astype(float)
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[self.docs] / mean))
        self.start, self.count = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
        self.start[there], self.count[there] = np.cumsum(count) - count, count
        long = np.flatnonzero(self.count >= max(2, LONG * self.n))
        self.column = np.full(len(vocab), -1)
        self.column[long] = np.arange(len(long))
        n_blocks = -(-self.n // BLOCK)
        self.postings = np.zeros((n_blocks * BLOCK, len(long)))
        for c, t in enumerate(long):
            s = slice(self.start[t], self.start[t] + self.count[t])
            self.postings[self.docs[s], c] = self.impact[s]
        self.most = self.postings.reshape(n_blocks, BLOCK, len(long)).max(1)
        self.block = np.arange(self.n) // BLOCK
        #: Blocks of long lists that queries met so far, and those whose postings were read.
        self.met = self.read = 0

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of what may be among the k best, given that k documents elsewhere have ``floor``.

        Block-max WAND: the largest impacts of the blocks that a document lies in
        bound its score. Documents whose bound reaches the threshold are pivots,
        and only the blocks of pivots are read: first those of the highest bounds, then the others
        in document order, more of them in each step. Every step raises the
        threshold, so the cursors pass over pivots that fall below it, and over all blocks without one.
        """
        column = self.column[terms]
        long = column >= 0
        n = np.where(long, 0, self.count[terms])
        bound = np.zeros(self.n)
        if total := int(n.sum()):
            take = np.repeat(self.start[terms] - (np.cumsum(n) - n), n) + np.arange(total)
            bound = np.bincount(self.docs[take], self.impact[take] * np.repeat(weights, n), self.n)
        columns = column[long]
        own = np.zeros(self.postings.shape[1])
        own[columns] = weights[long]
        exact = bound
        if len(columns):
            bound = exact + (self.most @ own)[self.block]
        self.met += len(columns) * len(self.most)
        picks, scores = [], []
        seeds = np.argpartition(-bound, 2 * k)[: 2 * k] if self.n > 4 * k else np.flatnonzero(bound >= max(floor - 1e-5, 1e-12))
        pivots, rest, step = seeds, None, 512
        while len(pivots):
            score = exact[pivots] + self.postings[pivots] @ own
            live = np.zeros(len(self.most), bool)
            live[self.block[pivots]] = True
            self.read += len(columns) * int(live.sum())
            picks.append(pivots)
            scores.append(score)
            if sum(map(len, scores)) >= k:
                floor = max(floor, np.partition(np.concatenate(scores), -k)[-k])
            if rest is None:
                ahead = bound >= max(floor - 1e-5, 1e-12)
                ahead[seeds] = False
                rest = np.flatnonzero(ahead)
            else:
                rest = rest[len(pivots) :]
                rest = rest[bound[rest] >= floor - 1e-5]
            pivots = rest[:step]
            step *= 4
        pick, score = (np.concatenate(x) for x in (picks, scores)) if picks else (seeds, np.zeros(0))
        ok = score >= max(floor - 1e-5, 1e-12)
        return pick[ok], score[ok]


FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def best_of(batches, queries: Queries, k: int):
    score = [np.zeros(0)] * len(queries.ids)
    docs: list[list] = [[] for _ in queries.ids]
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row, queries.vocab, queries.mean)
            for q, (terms, weights) in enumerate(zip(queries.terms, queries.weights)):
                floor = score[q].min() if len(score[q]) >= k else 0.0
                pick, got = shard.top(terms, weights, k, floor)
                if not len(pick):
                    continue
                got = np.concatenate([score[q], np.round(got, 6)])
                ids = docs[q] + [shard.ids[i] for i in pick]
                order = sorted(range(len(ids)), key=lambda i: (-got[i], ids[i] is not None, ids[i] or 0))[:k] if len(ids) <= 8 * k else smallest(got, ids, k)
                score[q], docs[q] = got[order], [ids[i] for i in order]
    cols = [[q for q, d in enumerate(docs) for _ in d], [queries.ids[q] for q, d in enumerate(docs) for _ in d], [x for d in docs for x in d], [float(x) for s in score for x in s]]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, FOUND)], schema=FOUND)


def smallest(score: np.ndarray, ids: list, k: int) -> list[int]:
    cut = np.partition(score, -k)[-k]
    near = np.flatnonzero(score >= cut).tolist()
    return sorted(near, key=lambda i: (-score[i], ids[i] is not None, ids[i] or 0))[:k]


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """query_id, rank, doc_id, score: the k best of ``docs`` (doc_id, text) for each of ``queries`` (query_id, text)."""
    text = F.coalesce("text", F.lit("")).alias("text")
    index = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(shards_of, SHARD), "shards")
    vectors = materialize(queries.select(F.col("query_id").cast("long").alias("query_id"), text).mapInArrow(vectors_of, "query_id long, terms binary, counts binary"), "queries")
    parts: list[DataFrame] = []

    def passed(rows: list) -> DataFrame:
        terms = [np.frombuffer(r.terms, np.uint64) for r in rows]
        vocab = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        counts = {r.term: r.n for r in index.select("lens", "terms", "counts").mapInArrow(lambda it: df_of(it, vocab), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
        n_docs, words = counts.pop(-1, 0), counts.pop(-2, 0)
        df = np.zeros(len(vocab))
        df[list(counts)] = list(counts.values())
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        numbers = [np.searchsorted(vocab, t) for t in terms]
        weights = [idf[i] * np.frombuffer(r.counts, np.int32) for i, r in zip(numbers, rows)]
        block = Queries([r.query_id for r in rows], vocab, numbers, weights, n_docs, max(words / max(n_docs, 1), 1e-9))
        best = index.mapInArrow(lambda it: best_of(it, block, k), "query long, query_id long, doc_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

    rows, held = [], 0
    for r in vectors.toLocalIterator():
        rows.append(r)
        held += len(r.terms) // 8
        if held >= query_terms:
            parts.append(materialize(passed(rows), "found"))
            rows, held = [], 0
    if rows or not parts:
        parts.append(passed(rows))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
