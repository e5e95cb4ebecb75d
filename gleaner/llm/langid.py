"""Language ID: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read segments of ``SEGMENT`` bytes, one from either
end; their states label every position, and a document's probabilities are the
mean over its letter positions. Gates and candidate use piecewise-linear
sigmoid and tanh, so a step is a gather, one small product and a few array
passes, for a thousand segments at once. The network is trained on the driver in
numpy, by backpropagation through time with Adam, on segments of a bounded
sample: about ``PER_LANG`` labelled rows for each of the ``MOST_LANGS`` most
frequent languages, none held out, ``SEGMENTS_PER_TEXT`` segments a row.

Whole texts are labelled, however long, a slice at a time. Null texts and texts
without a letter are ``und`` with score 0; a null id is not held out; repeated rows
get equal results; of equally likely languages the first by name is given. Where no
row has a language all are ``und``; an empty table gives an empty result. Only
``doc_id``, ``text`` and ``lang`` are read, so further columns do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import remainder, slices

HIDDEN = 16
SEGMENT = 128
TRAIN_SEGMENT = 64
BATCH = 1024
PER_LANG = 600
MOST_LANGS = 256
SEGMENTS_PER_TEXT = 6
EPOCHS = 6
FOLDS, HELD = 3, 1

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[0x80:] = True


@dataclass
class Net:
    langs: list[str]
    table: np.ndarray  # 2 directions x 256 bytes, 3 gates
    state: np.ndarray  # 2, HIDDEN, 3 gates
    out: np.ndarray  # 2, HIDDEN, languages
    bias: np.ndarray

    def positions(self, seg: np.ndarray) -> np.ndarray:
        """Logits (time, segment, language) of time-major segments."""
        steps, n = seg.shape
        h_size = self.state.shape[1]
        index = np.empty((2, n), np.int64)
        h = np.zeros((2, n, h_size), np.float32)
        logits = np.zeros((steps, n, len(self.langs)), np.float32)
        a = np.empty((2, n, 3 * h_size), np.float32)
        c = np.empty_like(a)
        gate = np.empty((2, n, 2 * h_size), np.float32)
        cand = np.empty((2, n, h_size), np.float32)
        y = np.empty((2, n, len(self.langs)), np.float32)
        for t in range(steps):
            index[0] = seg[t]
            np.add(seg[steps - 1 - t], 256, out=index[1], casting="unsafe", dtype=np.int64)
            np.take(self.table, index, axis=0, out=a, mode="clip")
            np.matmul(h, self.state, out=c)
            np.add(a[..., : 2 * h_size], c[..., : 2 * h_size], out=gate)
            gate *= 0.25
            gate += 0.5
            np.clip(gate, 0, 1, out=gate)
            np.multiply(gate[..., h_size:], c[..., 2 * h_size :], out=cand)
            cand += a[..., 2 * h_size :]
            np.clip(cand, -1, 1, out=cand)
            h -= cand
            h *= gate[..., :h_size]
            h += cand
            np.matmul(h, self.out, out=y)
            logits[t] += y[0]
            logits[steps - 1 - t] += y[1]
        logits += self.bias
        return logits

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over the letters of each text of a slice."""
        seg, row = segments(data, offsets, SEGMENT)
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        for k in range(0, len(row), BATCH):
            part = np.ascontiguousarray(seg[k : k + BATCH].T)
            p = self.positions(part)
            p -= p.max(-1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(-1, keepdims=True)
            p *= _letter[part][..., None]
            np.add.at(total, row[k : k + BATCH], p.sum(0))
        return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def segments(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(segments, bytes) padded with spaces, and the row of each; none crosses texts."""
    n = -(-np.diff(offsets) // size)
    edge = (np.append(0, np.cumsum(n)) * size).tolist()
    out = np.full(edge[-1], 32, np.uint8)
    for at, a, b in zip(edge, offsets[:-1].tolist(), offsets[1:].tolist()):
        out[at : at + b - a] = data[a:b]
    return out.reshape(-1, size), np.repeat(np.arange(len(n)), n)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the letter positions of time-major segments, and its slopes by backpropagation through time."""
    steps, n = x.shape
    hs = p["state"].shape[1]
    kind = p["state"].dtype
    index = np.stack([x, x[::-1].astype(np.int64) + 256], 1)  # time, direction, segment
    h = np.zeros((2, n, hs), kind)
    kept = []
    states = np.zeros((steps, 2, n, hs), kind)
    for t in range(steps):
        a, c = p["table"][index[t]], np.matmul(h, p["state"])
        pre = 0.25 * (a[..., : 2 * hs] + c[..., : 2 * hs]) + 0.5
        gate = np.clip(pre, 0, 1)
        z, r = gate[..., :hs], gate[..., hs:]
        raw = a[..., 2 * hs :] + r * c[..., 2 * hs :]
        cand = np.clip(raw, -1, 1)
        kept.append((h, pre, z, r, c[..., 2 * hs :], raw, cand))
        h = cand + z * (h - cand)
        states[t] = h
    logits = np.matmul(states[:, 0], p["out"][0]) + np.matmul(states[::-1, 1], p["out"][1]) + p["bias"]
    logits -= logits.max(-1, keepdims=True)
    q = np.exp(logits)
    q /= q.sum(-1, keepdims=True)
    weight = _letter[x].astype(kind)
    weight /= max(1, weight.sum())
    loss = float(-(weight * np.log(np.maximum(q[:, np.arange(n), y], 1e-30))).sum())
    q[:, np.arange(n), y] -= 1
    q *= weight[..., None]
    g = {key: np.zeros_like(v) for key, v in p.items()}
    g["bias"] = q.sum((0, 1))
    g["out"][0] = np.tensordot(states[:, 0], q, ((0, 1), (0, 1)))
    g["out"][1] = np.tensordot(states[::-1, 1], q, ((0, 1), (0, 1)))
    outer = np.stack([np.matmul(q, p["out"][0].T), np.matmul(q, p["out"][1].T)[::-1]], 1)
    dh = np.zeros((2, n, hs), kind)
    grads = np.empty((steps, 2, n, 3 * hs), kind)
    for t in range(steps - 1, -1, -1):
        h, pre, z, r, c_n, raw, cand = kept[t]
        dh = dh + outer[t]
        dn = dh * (1 - z) * (np.abs(raw) < 1)
        live = 0.25 * ((pre > 0) & (pre < 1))
        d = np.concatenate([dh * (h - cand) * live[..., :hs], dn * c_n * live[..., hs:], dn * r], -1)
        g["state"] += np.matmul(h.transpose(0, 2, 1), d)
        dh = dh * z + np.matmul(d, p["state"].transpose(0, 2, 1))
        d[..., 2 * hs :] = dn
        grads[t] = d
    flat, by = grads.reshape(-1, 3 * hs), index.reshape(-1)
    some = np.argsort(by, kind="stable")
    ids, first = np.unique(by[some], return_index=True)
    g["table"][ids] = np.add.reduceat(flat[some], first, axis=0)
    return loss, g


def start(n_lang: int, rng: np.random.Generator, hs: int = HIDDEN) -> dict[str, np.ndarray]:
    return {
        "table": rng.normal(0, 0.3, (512, 3 * hs)).astype(np.float32),
        "state": rng.normal(0, 0.8 / np.sqrt(hs), (2, hs, 3 * hs)).astype(np.float32),
        "out": rng.normal(0, 0.3, (2, hs, n_lang)).astype(np.float32),
        "bias": np.zeros(n_lang, np.float32),
    }


def fit(seg: np.ndarray, label: np.ndarray, langs: list[str], epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam over shuffled batches of segments."""
    rng = np.random.default_rng(seed)
    p = start(len(langs), rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    done, total = 0, epochs * max(1, len(seg) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(seg))
        for k in range(max(1, len(seg) // batch)):
            pick = order[k * batch : (k + 1) * batch]
            _, g = gradients(p, seg[pick].T, label[pick])
            done += 1
            norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            now = rate * min(1, 2 * (1 - done / (total + 1)))
            for key in p:
                gk = g[key] * min(1, 1 / (norm + 1e-9))
                m[key] = 0.9 * m[key] + 0.1 * gk
                v2[key] = 0.999 * v2[key] + 0.001 * gk**2
                p[key] -= now * (m[key] / (1 - 0.9**done)) / (np.sqrt(v2[key] / (1 - 0.999**done)) + 1e-8)
    return Net(langs, p["table"], p["state"], p["out"], p["bias"])


def examples(batches):
    """Up to ``SEGMENTS_PER_TEXT`` segments of each text, chosen by the text's own hash."""
    for batch in batches:
        place, which = [], []
        for lo, _, data, offsets in slices(batch.column("text")):
            own, row = segments(data, offsets, TRAIN_SEGMENT)
            first = np.searchsorted(row, np.arange(len(offsets)))
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                rng = np.random.default_rng(abs(batch.column("place")[lo + i].as_py()))
                pick = a + rng.permutation(b - a)[:SEGMENTS_PER_TEXT]
                place += [x.tobytes() for x in own[pick]]
                which += [lo + i] * len(pick)
        which = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(which), batch.column("place").take(which), pa.array(place, pa.binary())], names=["lang", "place", "segment"])


def train(docs: DataFrame, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> Net | None:
    """The network, fitted on about ``per_lang`` rows of each of the ``most_langs`` most frequent languages.

    No text is shuffled: the shares, a row a language, are broadcast, tasks cut
    their own sampled texts into segments, and only those come to the driver, a bounded number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", FOLDS) != HELD))
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    shares = [(r.lang, per_lang / r.n) for r in share.collect()]
    if not shares:
        return None
    share = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    place = F.xxhash64("doc_id", "text")
    chosen = rows.join(F.broadcast(share), "lang").withColumn("place", place).where(F.pmod(F.col("place"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    cut = chosen.select("lang", "place", "text").mapInArrow(examples, "lang string, place long, segment binary")
    # Equal rows are the only ties of this order, so the sample is the same whatever the tasks.
    found = cut.orderBy("place", "lang", "segment").limit(2 * per_lang * SEGMENTS_PER_TEXT * len(shares)).toArrow()
    if not found.num_rows:
        return None
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    number = {x: k for k, x in enumerate(langs)}
    seg = np.frombuffer(b"".join(found.column("segment").to_pylist()), np.uint8).reshape(-1, TRAIN_SEGMENT)
    return fit(seg, np.array([number[x] for x in names]), langs)


def labels_of(batches, net: Net | None):
    for batch in batches:
        lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
        langs: list[str] = ["und"] * batch.num_rows
        score = np.zeros(batch.num_rows)
        if net is not None:
            for lo, hi, data, offsets in slices(batch.column("text")):
                p = net.pooled(data, offsets)
                best = p.argmax(1)
                for i in range(lo, hi):
                    if lettered[i]:
                        langs[i] = net.langs[best[i - lo]]
                        score[i] = min(1.0, p[i - lo, best[i - lo]])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    net = train(docs, per_lang)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(lambda it: labels_of(it, net), "doc_id long, held_out boolean, lang_pred string, score double")
