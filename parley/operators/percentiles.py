"""Exact nearest-rank percentiles of few, large groups: values are counted, ranged over tasks and summed up by file.

Equal values of a group become one row with their number before anything is moved, so a value that half of the rows have
costs no more than any other.  The distinct values go to range partitions once; running totals go by file, and of the files
only their totals meet.  So neither a group nor its distinct values are ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.storage import place, shared_path


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(*keys, a column for each wanted): the value at rank ceil(p n) of a group's values that aren't NULL, as double.

    Groups without a value have no row; NULL keys are a group.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "ranks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts.repartitionByRange(parts, *keys, "_v").sortWithinPartitions(*keys, "_v").write.parquet(path)
    held = spark.read.schema(counts.schema).parquet(path).select(*keys, "_v", "_n", *place()).drop("_row")
    files = held.groupBy(*keys, "_part", "_file").agg(F.sum("_n").alias("_own"))
    group = W.partitionBy(*keys)
    files = files.withColumn("_before", F.sum("_own").over(group.orderBy("_part", "_file").rowsBetween(W.unboundedPreceding, 0)) - F.col("_own")).withColumn("_total", F.sum("_own").over(group))
    same = F.col("h._file") == F.col("f._file")
    for k in keys:
        same = same & F.col(f"h.{k}").eqNullSafe(F.col(f"f.{k}"))
    own = held.alias("h").join(files.alias("f"), same).select(*(F.col(f"h.{k}") for k in keys), "h._v", "h._n", "h._file", "_before", "_total")
    until = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_file").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("_until", until)

    def here(p: float):
        rank = F.greatest(F.ceil(F.col("_total") * F.lit(p) - 1e-9), F.lit(1))
        return (F.col("_until") >= rank) & (F.col("_until") - F.col("_n") < rank)

    return own.groupBy(*keys).agg(*(F.max(F.when(here(p), F.col("_v"))).cast("double").alias(name) for name, p in wanted.items()))
