"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat numpy arrays.

Inputs are ratios of text statistics only: no label, language, source or id.  Trees are grown depth by depth from
per-bin sums of gradients; a fitted model is five arrays (feature, threshold, left, right, value), and a batch of
documents walks all of a tree's levels at once.  Null texts score as empty ones.  A sample without both classes gives a
constant score, the share of label 1 (0.5 where there is no label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, bounded_batches
from parley.llm.quality_rules import MAX_LABELLED, cuts, labelled_sample
from parley.llm.textstats import count_batch, ratios

#: Rows whose crc32(doc_id as text) has this remainder by 3 are held out.
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Forest:
    base: float
    roots: np.ndarray
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int


def predict(model: Forest, x: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each row."""
    total = np.full(len(x), model.base)
    rows = np.arange(len(x))
    for root in model.roots:
        node = np.full(len(x), root)
        for _ in range(model.depth):
            f = model.feature[node]
            inner = f >= 0
            go_left = x[rows, np.maximum(f, 0)] <= model.threshold[node]
            node = np.where(inner, np.where(go_left, model.left[node], model.right[node]), node)
        total += model.value[node]
    return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_leaf: int = 5) -> Forest:
    """Second-order boosting of logistic loss on binned inputs."""
    empty = np.zeros(0, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else (0.999 if y[0] else 0.001)
        return Forest(float(np.log(share / (1 - share))), empty, empty, empty.astype(float), empty, empty, empty.astype(float), depth)
    edges = [cuts(x[:, f], bins - 1) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for part, first in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            part.append(first)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        root = node()
        roots.append(root)
        level = [(root, np.arange(len(y)))]
        for d in range(depth + 1):
            following = []
            for at, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                value[at] = -rate * g / (h + l2)
                best = (1e-6, None, None)
                if d < depth and len(rows) >= 2 * min_leaf:
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, f]
                        gs = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                        hs = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                        ns = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                        gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g**2 / (h + l2)
                        gain[(ns < min_leaf) | (len(rows) - ns < min_leaf)] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] is None:
                    score[rows] += value[at]
                    continue
                _, f, k = best
                feature[at], threshold[at], left[at], right[at] = f, float(edges[f][k]), node(), node()
                goes = binned[rows, f] <= k
                following += [(left[at], rows[goes]), (right[at], rows[~goes])]
            level = following
    return Forest(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), depth)


def scorer(model: Forest):
    """A vectorised Spark function from text to score."""

    @arrow_function("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(predict(model, ratios(count_batch(text))), pa.float64())

    return score


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """A score for every document; the model has seen labels of the rows that aren't held out only.

    One row a row: rows that repeat and equal texts score alike, null and empty texts like a text without words.  A null id
    is never held out nor learned from.  A score of exactly 0.5 predicts 1.  Without documents there are no rows, without
    labels every score is 0.5.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bounded_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    x, y = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MAX_LABELLED, ~held)
    model = fit(x, y)
    scored = docs.select("doc_id", held.alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
