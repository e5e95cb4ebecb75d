"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

Features: densities of a lexicon, its hits near second-person words, shouted
words, capitals, punctuation, obfuscation (letters next to digits or symbols
inside a word), and the style features. The lexicon holds words and word
beginnings of 5 to 7 bytes that toxic training texts have much oftener than the
others; words are compared by their letters alone, lower case, with common digit
disguises undone. It is learned, like the trees and the calibration, from at
most ``SAMPLE`` labelled rows outside the held-out fold. Scoring runs over all
documents, whole texts, in one pass without a shuffle.

Null and empty texts get the score of an empty text; a null id is not held out; a
label other than 0 and 1 is none. Repeated rows get equal scores, and count as often as
they stand; the calibration gives equal margins one score. An empty table gives an empty
result; only ``doc_id``, ``text`` and the label are read, so further columns do not clash.
With fewer than ``LEAST`` labelled rows of either kind all scores are the base rate.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import SPACE, hash_spans, lean, relieve, remainder, slices, word_spans
from gleaner.llm.gbt import Isotonic, Trees, cross_margins, fit_isotonic, fit_trees
from gleaner.llm.style import SECOND_PERSON, labelled, row_sum, style

SAMPLE = 8000
LEAST = 5
FOLDS, HELD = 5, 0
THRESHOLD = 0.5
PREFIXES = (5, 6, 7)
NEAR_WORDS = 4

_plain = np.zeros(256, np.uint8)
_plain[97:123] = np.arange(97, 123)
_plain[65:91] = np.arange(97, 123)
_plain[0x80:] = np.arange(0x80, 256)
for _a, _b in zip(b"01345@", b"oieasa"):
    _plain[_a] = _b


@dataclass
class Lexicon:
    keys: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            pos = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[pos] == hashes[maybe], self.weight[pos], 0)
        return out


def plain_words(data: np.ndarray, offsets: np.ndarray):
    """Letters of a slice in lower case, their word spans (some empty), the rows' words, and which words hide something."""
    starts, ends, words = word_spans(data, offsets)
    plain = _plain[data]
    upper = (data >= 0x80) & (data <= 0x9E)  # after the lead byte C3: capitals
    upper[1:] &= data[:-1] == 0xC3
    upper[:1] = False
    plain[upper & (data != 0x97)] += 0x20
    kept = plain > 0
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=at[1:])
    # Something that is no letter between two letters, or a digit in disguise.
    letter = kept & ~((data >= 48) & (data <= 57)) & (data != 64)
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = ~letter[1:-1] & letter[:-2] & letter[2:] & ~SPACE[data[1:-1]] & (data[1:-1] != 39) & (data[1:-1] != 45)
    hid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inner, out=hid[1:])
    return plain[kept], at[starts], at[ends], words, (hid[ends] - hid[starts]) > 0


def word_keys(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Hashes of whole words and of their beginnings; 0 where a word is shorter."""
    size = ends - starts
    yield np.where(size > 2, hash_spans(letters, starts, ends), np.uint64(0))
    for n in PREFIXES:
        ok = np.flatnonzero(size > n)
        out = np.zeros(len(starts), np.uint64)
        out[ok] = hash_spans(letters, starts[ok], starts[ok] + n) ^ np.uint64(n)
        yield out


def second_person() -> np.ndarray:
    words = [w.encode() for w in SECOND_PERSON.split()]
    ends = np.cumsum([len(w) for w in words])
    letters = _plain[np.frombuffer(b"".join(words), np.uint8)]
    return np.sort(hash_spans(letters, ends - [len(w) for w in words], ends))


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    letters, starts, ends, words, hidden = plain_words(data, offsets)
    n = np.maximum(np.diff(words), 1)
    keys = list(word_keys(letters, starts, ends))
    weight = np.zeros(len(starts))
    for k in keys:
        np.maximum(weight, lexicon.weights(k), out=weight)
    hit = weight > 0
    you = np.isin(hash_spans(letters, starts, ends), second_person())
    near = np.zeros(len(hit), bool)
    for d in range(1, NEAR_WORDS + 1):
        near[d:] |= hit[d:] & you[:-d]
        near[:-d] |= hit[:-d] & you[d:]
    hits, strong, close = row_sum(hit, words), row_sum(np.round(weight * 1000).astype(np.int64), words) / 1000, row_sum(near, words)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    kinds = np.zeros(len(offsets) - 1)
    if hit.any():
        pairs = np.unique(np.stack([row[hit].astype(np.uint64), keys[0][hit]]), axis=1)
        np.add.at(kinds, pairs[0].astype(np.int64), 1)
    own = np.stack([hits, hits / n, strong, strong / n, close / n, close, kinds, row_sum(hidden, words) / n, row_sum(hidden & hit, words) / n, row_sum(you, words) / n], axis=1)
    return np.concatenate([own, style(data, offsets)], axis=1)


def learn_lexicon(table: pa.Table, y: np.ndarray, least: int = 4, odds: float = 2.0, most: int = 2000) -> Lexicon:
    # One kind of key at a time, which bounds what the driver holds.
    kinds = []
    for kind in range(1 + len(PREFIXES)):
        found, label, at = [], [], 0
        for batch in table.combine_chunks().to_batches():
            for lo, hi, data, offsets in slices(batch.column("text")):
                letters, starts, ends, words, _ = plain_words(data, offsets)
                row = np.repeat(np.arange(at + lo, at + hi), np.diff(words)).astype(np.uint64)
                keys = next(islice(word_keys(letters, starts, ends), kind, None))
                ok = keys > 0
                pairs = np.unique(np.stack([keys[ok], row[ok]]), axis=1)
                found.append(pairs[0])
                label.append(y[pairs[1].astype(np.int64)] > 0)
            at += batch.num_rows
        uniq, back = np.unique(np.concatenate(found), return_inverse=True)
        pos, every = np.bincount(back, np.concatenate(label)), np.bincount(back)
        often = pos >= least
        kinds.append((uniq[often], pos[often], every[often]))
    uniq, pos, all_ = (np.concatenate(x) for x in zip(*kinds))
    order = np.argsort(uniq, kind="stable")
    uniq, pos, all_ = uniq[order], pos[order], all_[order]
    p, n = y.sum(), len(y) - y.sum()
    score = np.log((pos + 0.5) / (p + 1)) - np.log((all_ - pos + 0.5) / (n + 1))
    ok = np.flatnonzero((pos >= least) & (score >= odds))
    ok = np.sort(ok[np.argsort(-score[ok], kind="stable")][:most])
    return Lexicon(uniq[ok], score[ok])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    calibrate: Isotonic | None
    base: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.base)
        return self.calibrate(self.trees.margin(features(data, offsets, self.lexicon)))


def table_features(table: pa.Table, lexicon: Lexicon) -> np.ndarray:
    return np.concatenate([features(data, offsets, lexicon) for b in table.combine_chunks().to_batches() for _, _, data, offsets in slices(b.column("text"))])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    table = labelled(docs, labels, "toxic", FOLDS, HELD, most)
    y = table.column("label").to_numpy().astype(float)
    if min(y.sum(), len(y) - y.sum()) < LEAST:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, float((y.sum() + 0.1) / (len(y) + 1)))
    # The lexicon and the trees learn from different halves, crosswise, so the trees see hits as new texts have them.
    half = np.arange(len(y)) % 2 == 0
    x = np.zeros((len(y), 0))
    for part in (half, ~half):
        lexicon = learn_lexicon(table.filter(pa.array(~part)), y[~part])
        got = table_features(table.filter(pa.array(part)), lexicon)
        if not x.shape[1]:
            x = np.zeros((len(y), got.shape[1]))
        x[part] = got
    trees = fit_trees(x, y)
    return Model(learn_lexicon(table, y), trees, fit_isotonic(cross_margins(x, y), y), float(y.mean()))


def scores_of(batches, model):
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for lo, hi, data, offsets in slices(batch.column("text")):
            score[lo:hi] = model.score(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])


def score_documents(docs: DataFrame, model, modulus: int, held: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "text")
    out = rows.mapInArrow(lambda it: scores_of(it, model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    return score_documents(docs, train(docs, labels, most), FOLDS, HELD, THRESHOLD)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model does not reject."""
    # The driver learns: without what earlier plans have freed, and what learning frees does not stay for the stages to come.
    relieve(docs.sparkSession)
    model = train(docs, labels, most)
    relieve(docs.sparkSession)
    schema = docs.schema

    def keep(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for lo, hi, data, offsets in slices(batch.column("text")):
                ok[lo:hi] = model.score(data, offsets) < threshold
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(lean(keep), schema)
