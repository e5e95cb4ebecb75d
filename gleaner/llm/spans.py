"""Substring dedup over sliding sentence spans.

A text is cut into sentences after ``. ! ?`` and at line ends. Text without a stop
for ``MAX_WORDS`` words is cut where its words say so: at the last word of least hash
of every ``MAX_WORDS`` words without another cut. So no cut depends on words further
off, and a repeated passage has the same cuts everywhere but for ``MAX_WORDS`` words
at its ends, also where it stands in the middle of other text. From every sentence
runs a span of ``SENTENCES`` sentences, longer while it has fewer than ``MIN_WORDS``
words, so that lines which many documents share are no passages. Equal spans are
joined globally by hash; where a document is not the first with a span (by doc_id,
then row), the span's sentences are removed from it, wherever they stand. Repeats
inside one document alone are its own (refrains, lists) and stay unless ``within`` is set, which
removes all but the first.

A task sends a document's first occurrence of a hash, and each hash once to the join, its
own first; the rest of a task's documents are surely not first and travel under keys
of their own, so a span in a third of all rows reaches its reducer a few times a
task and no more. Spans are compared with case and white space levelled (A-Z only).

Null texts stay null, empty ones empty; a text with fewer words than
``MIN_WORDS`` has no span; texts are read whole, however long. Of repeated rows with
one id and one text both stay; rows of one id and other texts, and rows without id,
are documents of their own, those without id the first. An empty table gives an empty
result; only ``doc_id`` and ``text`` are read, so further columns do not clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import LOWER, fresh, hash_spans, mix, powers, slices, word_spans
from gleaner.llm.linedup import row_key

SENTENCES = 3
MIN_WORDS = 20
MAX_WORDS = 12
#: Spans that a task gathers before it sends the first of each hash.
CHUNK = 1 << 20

SPAN_SCHEMA = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("later", pa.bool_())])


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Word spans of a slice, the first word of each sentence, and for each row its first sentence (n + 1 of them)."""
    starts, ends, words = word_spans(data, offsets)
    n = len(starts)
    if not n:
        return starts, ends, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    head = np.zeros(n + 1, bool)
    head[words] = True
    head = head[:-1]
    closing = data[ends - 1]
    stop = (closing == 46) | (closing == 33) | (closing == 63)
    newline = np.cumsum(data == 10)
    cut = head.copy()
    cut[1:] |= stop[:-1] | (newline[starts[1:]] != newline[ends[:-1] - 1])
    cut[content_cuts(hash_spans(LOWER[data], starts, ends), cut)] = True
    begins = np.flatnonzero(cut)
    return starts, ends, begins, np.searchsorted(begins, words)


def content_cuts(words: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The last word of least hash of every run of ``MAX_WORDS`` words that holds no cut."""
    if len(words) < MAX_WORDS:
        return np.zeros(0, np.int64)
    cuts = np.append(0, np.cumsum(cut))
    bare = np.flatnonzero(cuts[MAX_WORDS:] == cuts[:-MAX_WORDS])
    least, at = words[bare], bare.copy()
    for k in range(1, MAX_WORDS):
        here = words[bare + k]
        less = here <= least
        least[less], at[less] = here[less], bare[less] + k
    return at


def span_ends(begins: np.ndarray, rows: np.ndarray, n_words: int) -> np.ndarray:
    """For each sentence, the sentence after its span, or -1 where the text ends before."""
    edges = np.append(begins, n_words)
    own_end = np.repeat(rows[1:], np.diff(rows))
    end = np.maximum(np.arange(len(begins)) + SENTENCES, np.searchsorted(edges, begins + MIN_WORDS))
    return np.where(end <= own_end, end, -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, to: np.ndarray) -> np.ndarray:
    words = hash_spans(LOWER[data], starts, ends)
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    edges = np.append(begins, len(words))
    ok = np.flatnonzero(to >= 0)
    a, b = begins[ok], edges[to[ok]]
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def keyed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row in the slice and sentence in the row of every span of a slice."""
    starts, ends, begins, rows = sentences(data, offsets)
    to = span_ends(begins, rows, len(starts))
    ok = to >= 0
    if not ok.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.diff(rows)
    of = np.repeat(np.arange(len(n)), n)
    return span_hashes(data, starts, ends, begins, to), of[ok], (np.arange(len(begins)) - np.repeat(rows[:-1], n))[ok]


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where equal rows of sorted columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def spans_of(batches):
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        key, doc, row, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((pos, row, doc, key))
        order = order[runs(key[order], doc[order], row[order])]  # a document's first
        key, doc, row, pos = key[order], doc[order], row[order], pos[order]
        first = np.maximum.accumulate(np.where(runs(key), np.arange(len(key)), 0))
        later = row != row[first]
        key = np.where(later, mix(row.view(np.uint64) + pos.astype(np.uint64)), key)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(row), pa.array(pos.astype(np.int32)), pa.array(later)], schema=SPAN_SCHEMA)

    for batch in batches:
        # A null id goes before all others.
        doc_id = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        row_id = batch.column("row").to_numpy()
        for lo, _, data, offsets in slices(batch.column("text")):
            key, of, pos = keyed(data, offsets)
            if len(key):
                held.append((key, doc_id[lo + of], row_id[lo + of], pos))
                if sum(len(x[0]) for x in held) >= CHUNK:
                    yield flush()
    if held:
        yield flush()


def later_of(batches):
    """From spans sorted by key, doc_id, row and pos: those whose document is not the first of their key."""
    held = None  # key and row of the first of the last key
    for batch in batches:
        if not batch.num_rows:
            continue
        key, row = (batch.column(c).to_numpy() for c in ("key", "row"))
        first = np.maximum.accumulate(np.where(runs(key), np.arange(len(key)), 0))
        first_row = row[first]
        if held is not None and held[0] == key[0]:
            first_row[first == 0] = held[1]
        held = key[-1], first_row[-1]
        later = batch.column("later").to_numpy(zero_copy_only=False) | (row != first_row)
        pick = pa.array(np.flatnonzero(later))
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pick), batch.column("pos").take(pick)], names=["row", "pos"])


def covered(data: np.ndarray, offsets: np.ndarray, lists: pa.Array, within: bool) -> dict[int, list[int]]:
    """By row of a slice: the sentences whose spans go. ``lists``: a sentence of each span that an earlier document has."""
    if not within and lists.null_count == len(lists):
        return {}
    key, of, pos = keyed(data, offsets)
    if not len(key):
        return {}
    gone = np.zeros(len(key), bool)
    order = np.lexsort((pos, key, of))
    first = np.empty(len(key), np.int64)  # the first span of each hash and row
    first[order] = order[np.maximum.accumulate(np.where(runs(of[order], key[order]), np.arange(len(key)), 0))]
    if within:
        gone |= first != np.arange(len(key))
    begin = np.searchsorted(of, np.arange(len(lists) + 1))
    for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
        a, b = begin[i], begin[i + 1]
        gone[a:b] |= np.isin(pos[first[a:b]], lists[int(i)].as_py())
    out: dict[int, list[int]] = {}
    for i, k in zip(of[gone].tolist(), pos[gone].tolist()):
        out.setdefault(i, []).append(k)
    return out


def cut_of(batches, gone: str, schema: pa.Schema, within: bool):
    for batch in batches:
        lists = batch.column(gone)
        text = batch.column("text")
        out: list = [None] * len(text)
        total, removed = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        valid = text.is_valid().to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in slices(text):
            starts, _, begins, rows = sentences(data, offsets)
            to = span_ends(begins, rows, len(starts))
            total[lo:hi] = np.diff(rows)
            raw = data.tobytes()
            hits = covered(data, offsets, lists.slice(lo, hi - lo), within)
            for i in range(lo, hi):
                if not valid[i]:
                    continue
                a, b = rows[i - lo], rows[i - lo + 1]
                at, end = offsets[i - lo], offsets[i - lo + 1]
                if i - lo not in hits:
                    out[i] = raw[at:end].decode("utf-8", "replace")
                    continue
                pos = np.array(hits[i - lo], np.int64)
                change = np.zeros(b - a + 1, np.int64)
                np.add.at(change, pos, 1)
                np.add.at(change, to[a + pos] - a, -1)
                keep = np.cumsum(change[:-1]) == 0
                removed[i] = (~keep).sum()
                edges = np.append(starts[begins[a:b]], end)
                pieces = [raw[x:y] for x, y, k in zip(edges[:-1], edges[1:], keep) if k]
                out[i] = (raw[at : edges[0]] + b"".join(pieces)).decode("utf-8", "replace").rstrip(" \n") if pieces else ""
        arrays = [pa.array(out, pa.string()) if f.name == "text" else pa.array(total) if f.name == "n_sentences" else pa.array(removed) if f.name == "n_removed" else batch.column(f.name) for f in schema]
        yield pa.RecordBatch.from_arrays(arrays, names=schema.names)


def dedup_spans(docs: DataFrame, within: bool = False) -> DataFrame:
    """``doc_id``, cleaned ``text``, ``n_sentences``, ``n_removed`` of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_key())
    spans = docs.mapInArrow(spans_of, "key long, doc_id long, row long, pos int, later boolean")
    later = spans.repartition("key").sortWithinPartitions("key", "doc_id", "row", "pos").mapInArrow(later_of, "row long, pos int")
    gone = fresh(docs, "gone")
    found = later.groupBy("row").agg(F.collect_set("pos").alias(gone))
    out = docs.join(found, "row", "left").select("doc_id", "text", gone)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])
    return out.mapInArrow(lambda it: cut_of(it, gone, schema, within), "doc_id long, text string, n_sentences long, n_removed long")
