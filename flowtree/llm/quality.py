"""Quality classifier: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader.

Features are hashed unigrams and bigrams of lower-cased words and punctuation runs; a bigram of one token twice is
the same feature whatever the token. A document's vector is term frequency over the square root of its n-gram count.
Weights come from per-coordinate FTRL-proximal updates (McMahan et al. 2013), one document at a time; a document's
score is the sparse dot product with them. The threshold is the one of best balanced accuracy on a held-out quarter.

Defined results: a null or empty text has no feature and scores the bias alone, and is rejected, as it holds nothing
to keep. With no labelled rows of either class there is no model: every document scores null and is kept. Repeated
rows are each scored alike. Columns other than doc_id and text are never read, and ``filter_quality`` passes them on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import labelled
from .textblocks import WORDS_AND_MARKS, blocks, offsets, shingles, tokens

#: Production parameters.
BITS, ORDER, ALPHA, BETA, L1, L2 = 20, 2, 0.3, 1.0, 0.02, 0.1
#: Passes over the rows, and updates that small sets have at least.
EPOCHS, LEAST_UPDATES = 4, 6000
_SAME = np.uint64(0x51)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float
    bits: int = BITS
    order: int = ORDER


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of a block, sorted by row."""
    h, rows = tokens(data, off, WORDS_AND_MARKS)
    grams, owners = [h], [rows]
    for n in range(2, order + 1):
        g, r = shingles(h, rows, n, whole=False)
        if n == 2 and len(h) > 1:
            inside = rows[1:] == rows[:-1]
            g = np.where((h[1:] == h[:-1])[inside], _SAME, g)
        grams.append(g)
        owners.append(r)
    at = (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)
    of = np.concatenate(owners)
    order_ = np.argsort(of, kind="stable")
    return at[order_], of[order_]


def margins(texts: pa.Array, model: Model) -> np.ndarray:
    """The score before the logistic function; NaN where the text has no token."""
    out = np.full(len(texts), np.nan)
    for first, end, data, off in blocks(texts):
        at, rows = features(data, off, model.bits, model.order)
        cut = offsets(rows, end - first)
        sums = np.append(0.0, np.cumsum(model.weights[at], dtype=np.float64))
        count = np.diff(cut)
        some = count > 0
        out[first:end][some] = model.bias + (sums[cut[1:]] - sums[cut[:-1]])[some] / np.sqrt(count[some])
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, balance: np.ndarray, order: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(weights, bias) after an update for each of ``order``, places of rows (ids, values); per-coordinate FTRL-proximal, the bias without L1."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0

    def weights(ids):
        zi = z[ids]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    for k in order:
        ids, x = rows[k]
        w = weights(ids)
        p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
        g0 = (p - y[k]) * balance[k]
        g = g0 * x
        step = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
        z[ids] += g - step * w
        n[ids] += g * g
        step = (np.sqrt(nb + g0 * g0) - np.sqrt(nb)) / ALPHA
        zb += g0 - step * bias
        nb += g0 * g0
        bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
    return weights(np.arange(1 << bits)), bias


def fit(table: pa.Table, seed: int = 7) -> Model | None:
    """Trains on a table of text and y (0 or 1); None unless both classes are there."""
    y = table["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for first, end, data, off in blocks(table["text"]):
        at, of = features(data, off)
        cut = offsets(of, end - first)
        for k in range(end - first):
            ids, tf = np.unique(at[cut[k] : cut[k + 1]], return_counts=True)
            rows.append((ids, tf / np.sqrt(max(1, tf.sum()))))
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.25
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    use = np.flatnonzero(~held)
    order = np.concatenate([rng.permutation(use) for _ in range(max(EPOCHS, -(-LEAST_UPDATES // len(use))))])
    weights, bias = ftrl(rows, y, balance, order)
    model = Model(weights.astype(np.float32), bias, 0.0)
    test = np.flatnonzero(held) if held.any() else np.arange(len(y))
    m, t = margins(table["text"].take(test), model), y[test] > 0
    ok = ~np.isnan(m)
    m, t = m[ok], t[ok]
    order = np.argsort(m)
    m, t = m[order], t[order]
    if len(m) and t.any() and not t.all():
        # rejecting the k lowest: share of good ones kept + share of bad ones rejected; of equal bests the lowest
        gain = (1 - np.append(0, np.cumsum(t)) / t.sum()) + np.append(0, np.cumsum(~t)) / (~t).sum()
        k = int(np.argmax(gain))
        low, high = (m[k - 1] if k else m[0] - 1), (m[k] if k < len(m) else m[-1] + 1)
        model.threshold = float(low + (high - low) / 4)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS) -> Model | None:
    got = labelled.fitted(labelled.sample(docs, labels, "quality", per_class), fit)
    return None if got is None else Model(**got)


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, keep) of every row."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        if model is None:
            s, keep = pa.nulls(len(texts), pa.float64()), np.ones(len(texts), bool)
        else:
            m = margins(texts, model)
            keep = m >= model.threshold
            s = pa.array(1 / (1 + np.exp(-np.clip(np.where(np.isnan(m), model.bias, m), -500, 500))))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), s, pa.array(keep)], ["doc_id", "score", "keep"])

    return labelled.scored(docs, ["doc_id", "text"], "doc_id long, score double, keep boolean", score)


def filter_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows that are kept, with all their columns."""
    if model is None:
        return docs
    return labelled.kept(docs, ["text"], lambda batch: margins(batch.column(0), model) >= model.threshold)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
