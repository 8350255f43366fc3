"""Turns, gaps, collapses and firsts over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def turns(rows: DataFrame, key: str, order: str, boundary: Column, name: str = "turn_no") -> DataFrame:
    """Numbers turns: a boundary starts the next one; what precedes the first is turn 0."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(boundary, 1).otherwise(0)).over(w).cast("bigint"))


def active_time(rows: DataFrame, key: str, ms: str, idle_ms: int, name: str = "active_ms") -> DataFrame:
    """Per key the sum of gaps of at most ``idle_ms`` between its distinct times."""
    times = rows.select(key, ms).distinct()
    gap = F.col(ms) - F.lag(ms).over(W.partitionBy(key).orderBy(ms))
    return times.withColumn("_gap", gap).groupBy(key).agg(F.coalesce(F.sum(F.when((F.col("_gap") > 0) & (F.col("_gap") <= idle_ms), F.col("_gap"))), F.lit(0)).cast("bigint").alias(name))


def collapse_repeats(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Without rows whose value equals (NULL included) that of the row before."""
    w = W.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(value).over(w))
    return kept.filter((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_n", "_before")


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str], n: int = 1, name: str | None = None) -> DataFrame:
    """The first n rows of each key; ties need a total order."""
    rank = name or "_rank"
    out = rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(F.col(rank) <= n)
    return out if name else out.drop(rank)


def ordered_text(key: list[str], order: str, text: str, sep: str = "\n") -> Column:
    """Aggregate: the texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), sep)


def max_concurrent(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key the most intervals open at once; at one instant ends come before starts."""
    edges = rows.select(key, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(rows.select(key, F.col(end).alias("at"), F.lit(-1).alias("d")))
    open_ = F.sum("d").over(W.partitionBy(key).orderBy("at", "d").rowsBetween(W.unboundedPreceding, 0))
    return edges.withColumn("_open", open_).groupBy(key).agg(F.max("_open").cast("bigint").alias("max_open"))


def longest_runs(pairs: DataFrame, key: str, i: str, j: str, least: int = 3) -> DataFrame:
    """Longest stretches of matched positions (i, j) along a diagonal; ties go to the smallest offset, then start."""
    rows = pairs.withColumn("_d", F.col(j) - F.col(i))
    rows = rows.withColumn("_island", F.col(i) - F.row_number().over(W.partitionBy(key, "_d").orderBy(i)))
    runs = rows.groupBy(key, "_d", "_island").agg(F.count(F.lit(1)).alias("run"), F.min(i).alias("start_i"), F.min(j).alias("start_j")).filter(F.col("run") >= least)
    return first_by(runs, [key], [F.desc("run"), F.asc("_d"), F.asc("start_i")]).select(key, "run", "start_i", "start_j")
