"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows of quality 1; unlabelled text is drawn from
the documents without looking at labels; rows of quality 0 are not used. An
additive model over quantile bins of the style features minimises

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss, so its sigmoid is the probability of quality 1. The
class prior is estimated as the smallest ratio of unlabelled to positive mass over
regions that a first, unweighted model ranks as most alike the positives; the
unlabelled mass is counted over all documents outside the held-out fold.

The samples that the models are fitted on are at most ``POSITIVES`` and ``UNLABELLED``
rows outside the held-out fold. Scoring runs over all documents, whole texts, in one
pass without a shuffle. Null and empty texts get the score of an empty text; a null id
is not held out; a label other than 0 and 1 is none. Repeated rows get equal scores, and
count as often as they stand; equal values share a bin, so ties get equal scores. An
empty table gives an empty result; only ``doc_id``, ``text`` and the label are read, so further
columns do not clash. With fewer than ``LEAST`` trusted positives every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import remainder, slices
from gleaner.llm.gbt import binned, sigmoid
from gleaner.llm.style import labelled, sampled, style
from gleaner.llm.toxicity import score_documents

POSITIVES, UNLABELLED = 6000, 9000
LEAST = 5
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
BINS = 24


@dataclass
class Additive:
    edges: list[np.ndarray]
    weight: np.ndarray  # features x bins
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        return self.bias + self.weight[np.arange(b.shape[1]), b].sum(1)


@dataclass
class Model:
    net: Additive | None
    prior: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(offsets) - 1, 0.5)
        return sigmoid(self.net.margin(style(data, offsets)))


def fit_pu(xp: np.ndarray, xu: np.ndarray, prior: float | None, steps: int = 400, rate: float = 0.05, l2: float = 2e-4) -> Additive:
    """Adam on the non-negative risk; ``prior`` None: plain positives against unlabelled."""
    both = np.concatenate([xp, xu])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(both.shape[1])]
    width = BINS + 1
    place = lambda x: binned(x, edges) + np.arange(x.shape[1]) * width
    p, u = place(xp), place(xu)
    size = both.shape[1] * width
    w = np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def gradient(at: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(at.ravel(), np.repeat(g, at.shape[1]), size + 1)
        out[-1] = g.sum()
        return out

    for t in range(1, steps + 1):
        sp, su = sigmoid(w[p].sum(1) + w[-1]), sigmoid(w[u].sum(1) + w[-1])
        if prior is None:
            grad = gradient(p, (sp - 1) / len(sp)) + gradient(u, su / len(su))
        else:
            # Loss of calling a row negative is log(1 + exp(margin)), its slope the sigmoid.
            negative = np.log1p(np.exp(np.clip(w[u].sum(1) + w[-1], -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(w[p].sum(1) + w[-1], -30, 30))).mean()
            part = gradient(u, su / len(su)) - gradient(p, prior * sp / len(sp))
            grad = -part if negative < 0 else gradient(p, prior * (sp - 1) / len(sp)) + part
        grad = grad + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Additive(edges, w[:-1].reshape(-1, width), float(w[-1]))


def fold_of(doc_id: np.ndarray) -> np.ndarray:
    return ((doc_id.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & 1


def masses(batches, nets: list[Additive], cuts: np.ndarray):
    """Rows at or above each cut by the network that has not seen them, and as cut -1 all rows."""
    above, total = np.zeros(len(cuts), np.int64), 0
    for batch in batches:
        fold = fold_of(batch.column("doc_id").to_numpy())
        for lo, hi, data, offsets in slices(batch.column("text")):
            x = style(data, offsets)
            margin = np.where(fold[lo:hi] == 0, nets[0].margin(x), nets[1].margin(x))
            above += (margin[:, None] >= cuts).sum(0)
            total += hi - lo
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(cuts))), pa.array(np.append(total, above))], names=["cut", "n"])


def estimate_prior(docs: DataFrame, p: pa.Table, u: pa.Table, xp: np.ndarray, xu: np.ndarray, modulus: int, held: int, least: float = 0.3) -> float:
    """Smallest unlabelled-to-positive ratio over top regions holding ``least`` of the positives or more, by cross-fitting.

    The regions are ranked by networks of the two samples; the unlabelled mass of
    each is counted over all documents outside the held-out fold.
    """
    fp, fu = fold_of(p.column("doc_id").to_numpy()), fold_of(u.column("doc_id").to_numpy())
    if min((fp == 0).sum(), (fp == 1).sum(), (fu == 0).sum(), (fu == 1).sum()) < 1:
        fp, fu = np.arange(len(xp)) % 2, np.arange(len(xu)) % 2
    nets = [fit_pu(xp[fp != k], xu[fu != k], None, steps=200) for k in (0, 1)]
    mp = np.where(fp == 0, nets[0].margin(xp), nets[1].margin(xp))
    cuts = np.quantile(mp, np.linspace(0.01, 1 - least, 60))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held))
    found = {r.cut: r.n for r in rows.mapInArrow(lambda it: masses(it, nets, cuts), "cut long, n long").groupBy("cut").agg(F.sum("n").alias("n")).collect()}
    total = max(1, found.get(-1, 0))
    ratio = [found.get(k, 0) / total / max((mp >= c).mean(), 1e-9) for k, c in enumerate(cuts)]
    return float(np.clip(np.min(ratio), 0.05, 0.98))


def unlabelled(docs: DataFrame, modulus: int, held: int, most: int) -> pa.Table:
    """Up to ``most`` rows, the first by hash of the id, none held out; at most that many ids are broadcast."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held)).orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(most).distinct()
    return sampled(docs, ids, most)


def table_style(table: pa.Table) -> np.ndarray:
    return np.concatenate([style(data, offsets) for b in table.combine_chunks().to_batches() for _, _, data, offsets in slices(b.column("text"))])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, sample: int = UNLABELLED) -> Model:
    p = labelled(docs, labels, "quality", FOLDS, HELD, positives, only=1)
    u = unlabelled(docs, FOLDS, HELD, sample)
    if min(p.num_rows, u.num_rows) < LEAST:
        return Model(None, 0.5)
    xp, xu = table_style(p), table_style(u)
    prior = estimate_prior(docs, p, u, xp, xu, FOLDS, HELD)
    return Model(fit_pu(xp, xu, prior), prior)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels), FOLDS, HELD, THRESHOLD)
