"""Dense style features of whole texts, a few array passes a slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import LOWER, hash_spans, remainder, word_spans

# Second-person words of the corpus's languages.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen usted ustedes tú ti tuyo vosotros os su"
SYMBOLS = b"#$%&*@~^_=+<>{}[]\\/"
STYLE_NAMES = "log_words log_bytes word_length upper digits exclaims questions stops commas bars symbols newlines high shouted titled single symbol_ended distinct top_share repeats"

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_letter = _upper.copy()
_letter[97:123] = True
_letter[0x80:] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True


def row_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def style(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text of a slice; an empty text has zeros."""
    starts, ends, words = word_spans(data, offsets)
    n_bytes, n_words = np.diff(offsets).astype(float), np.diff(words).astype(float)
    per_byte = lambda mask: row_sum(mask, offsets) / np.maximum(n_bytes, 1)
    per_word = lambda mask: row_sum(mask, words) / np.maximum(n_words, 1)
    upper = _upper[data]
    caps = np.zeros(len(data) + 1, np.int64)
    np.cumsum(upper, out=caps[1:])
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_letter[data] & (data != 0xC3), out=letters[1:])
    size = ends - starts
    word_caps, word_letters = caps[ends] - caps[starts], letters[ends] - letters[starts]
    first, last = data[starts], data[ends - 1]
    key = hash_spans(LOWER[data], starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(k)))
    distinct, top = np.zeros(len(n_words)), np.zeros(len(n_words))
    np.add.at(distinct, r[at], 1)
    np.maximum.at(top, r[at], count)
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    some = np.maximum(n_words, 1)
    return np.stack(
        [
            np.log1p(n_words), np.log1p(n_bytes), n_bytes / some, per_byte(upper), per_byte(_digit[data]), per_byte(data == 33), per_byte(data == 63), per_byte(data == 46), per_byte(data == 44),
            per_byte(data == 124), per_byte(_symbol[data]), per_byte(data == 10), per_byte(data == 0xC3), per_word((word_caps >= 2) & (word_caps * 2 > word_letters)), per_word(_upper[first]), per_word(size == 1), per_word(_symbol[last]),
            distinct / some, top / some, per_word(same),
        ],
        axis=1,
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, only: int | None = None) -> pa.Table:
    """Up to ``most`` labelled rows (text, label), the first by hash of the id, none held out.

    Labels other than 0 and 1 are no labels. The ids are at most ``most`` longs, so
    broadcasting them is bounded; where ids repeat, the first 2 * ``most`` rows by hash of id and text are taken.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder("doc_id", modulus) != held))
    if only is not None:
        rows = rows.where(F.col("label") == only)
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id", "label").limit(most).distinct()
    return sampled(docs, rows, most)


def sampled(docs: DataFrame, ids: DataFrame, most: int) -> pa.Table:
    """The rows of ``docs`` with one of ``ids``, 2 * ``most`` at most: a total order decides, whatever the tasks."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    first = found.orderBy(F.xxhash64("doc_id", "text"), *(c for c in found.columns if c != "text"), "text").limit(2 * most)
    return first.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
