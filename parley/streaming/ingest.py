"""Incremental ingest and event-time sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.commits import CommitTable


def sync(spark: SparkSession, source: str, schema: str, target: CommitTable, state: str, latest_by: list[str] | None = None) -> int:
    """Merges the rows of the files that arrived since the last call into ``target``; gives the table's version.

    Only buckets that a batch touches are read and written.  Idempotent: a batch is a commit named by its number, so one that
    is run again after a failure changes nothing, and a call without new files makes no version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        target.merge(batch, f"batch-{number}", latest_by)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return (target.manifest() or {"version": 0})["version"]


def sessions(events: DataFrame, key: str, ts: str, gap: str = "3 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions parted by gaps, for streams and tables; an extension."""
    g = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
