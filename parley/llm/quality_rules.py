"""Quality rules: an ordered decision list, learned by sequential covering from labelled statistics.

Rules are conjunctions of thresholds.  A rule is grown on two thirds of the labelled sample by FOIL gain, pruned on the
rest, and kept while it is precise there; the rows it covers leave the sample.  The list becomes one ordered Spark
conditional expression, so applying it needs no Python beyond the text statistics.

Null texts are empty texts; without labels of both classes the list is empty and only the base rules decide.
Columns of the input are kept: what ``apply_rules`` adds on its way takes a free name and goes again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded_batches, free_name
from parley.llm.textstats import RATIOS, ratio_column, text_stats

#: The most labelled rows that a list or classifier is fitted on; taken in hash order of doc_id.
MAX_LABELLED = 12_000


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, keep: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, label) of at most ``limit`` labelled documents, in hash order of doc_id: bounded, and even over sources.

    Repeated labels of a document: the smallest counts.  Of rows with one doc_id the text with the smallest hash counts, and
    one row an id is collected, so ``limit`` bounds what the driver holds.  ``keep`` filters the labels by doc_id before
    sampling.  Null ids and null labels are never learned from.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
    if keep is not None:
        marks = marks.filter(keep)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # The sample has at most ``limit`` rows of 12 bytes, so it may be broadcast.
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").join(F.broadcast(marks), "doc_id").select("doc_id", "quality", "h", text_stats("text").alias("s"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "s")).alias("one")).select("doc_id", "quality", "one.s")
    rows = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), *(ratio_column("s", k).alias(k) for k in RATIOS))
    got = rows.toPandas().sort_values("doc_id", kind="stable")
    return got[list(RATIOS)].to_numpy(np.float64).reshape(-1, len(RATIOS)), got["quality"].to_numpy(np.int64)


def cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """At most ``most`` thresholds, halfway between neighbouring distinct values at even ranks."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.zeros(0)
    at = np.unique(np.linspace(0, len(distinct) - 2, min(most, len(distinct) - 1)).astype(int))
    return (distinct[at] + distinct[at + 1]) / 2


def covers(x: np.ndarray, conditions) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    names = list(RATIOS)
    for c in conditions:
        v = x[:, names.index(c.feature)]
        hit &= v > c.threshold if c.above else v <= c.threshold
    return hit


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the greatest FOIL gain over these rows."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 / (p0 + n0)) if p0 else 0.0
    best: tuple[float, Condition | None] = (1e-9, None)
    for f, name in enumerate(RATIOS):
        edges = cuts(x[:, f])
        if not len(edges):
            continue
        slot = np.searchsorted(edges, x[:, f], side="left")
        p = np.bincount(slot[bad], minlength=len(edges) + 1)
        n = np.bincount(slot[~bad], minlength=len(edges) + 1)
        low_p, low_n = np.cumsum(p)[:-1], np.cumsum(n)[:-1]
        for above, pp, nn in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = float(gain[k]), Condition(name, above, float(edges[k]))
    return best


def learn_rules(x: np.ndarray, quality: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 3) -> list[Rule]:
    """Sequential covering for the low-quality class: grow, prune, keep while precise, take the covered rows out."""
    bad = quality == 0
    if not bad.any() or bad.all():
        return []
    # Hash order has made the sample random; every third row prunes.
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & bad).sum() >= min_covered:
        grow_at, inside, conditions = left & ~prune, left & ~prune, []
        if not (grow_at & bad).any():
            break
        while len(conditions) < max_conditions and (inside & ~bad).any() and (inside & bad).any():
            gain, found = _best_condition(x[inside], bad[inside])
            if found is None:
                break
            conditions.append(found)
            inside = grow_at & covers(x, conditions)
        if not conditions:
            break

        def worth(k: int) -> float:
            hit = left & prune & covers(x, conditions[:k])
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        cut = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        chosen = tuple(conditions[:cut])
        hit = left & covers(x, chosen)
        p, total = int((hit & bad).sum()), int(hit.sum())
        if p < min_covered or p < min_precision * total:
            break
        rules.append(Rule(chosen, p, p / total))
        left &= ~hit
    return rules


def rule_expression(rules: list[Rule], stats: str) -> Column:
    """The list in order: the number of the first rule that fires, 0 if none does."""
    chain = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule.conditions:
            v = ratio_column(stats, c.feature)
            test = test & (v > c.threshold if c.above else v <= c.threshold)
        chain = F.when(test, F.lit(i)) if chain is None else chain.when(test, F.lit(i))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def with_stats(docs: DataFrame, stats: str) -> DataFrame:
    """``docs`` with a struct of statistics under the name ``stats`` (see ``free_name``)."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(stats, text_stats(F.col("text")))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that neither the base rules nor the learned list rejects, with their columns unchanged."""
    stats = free_name(docs, "parley_stats")
    flagged = with_stats(docs, stats)
    return flagged.filter(~base_failed(stats) & (rule_expression(rules, stats) == 0)).drop(stats)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its statistics, the base verdict and the learned verdict.

    One row a row: rows that repeat, equal texts and null ids are judged by their text, each alike.  Null and empty texts
    have no words and fail the base rules.  At a threshold a value counts as not above it.  Empty tables of documents give
    no rows, and of labels an empty list.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = learn_rules(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = with_stats(docs.select("doc_id", "text"), "s").drop("text")
    failed = base_failed("s")
    return out.select(
        "doc_id",
        *(F.col("s")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        (~failed & (rule_expression(rules, "s") == 0)).alias("kept"),
        rule_expression(rules, "s").alias("rule"),
    )

