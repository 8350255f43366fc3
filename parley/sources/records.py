"""One stream of mixed records, split into typed tables.

A line is a JSON object whose ``table`` names what it is.  Lines are parsed once, as VARIANT, and kept by table; a table reads
only the fields that it wants from it.  Lines that aren't JSON, are longer than ``most_bytes``, name no known table, or whose
``id`` isn't one of their table are errors, with the reason: ``strict`` refuses the stream, else they are kept apart.  A
stream that lacks one of the tables isn't whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.storage import shared_path

MOST_BYTES = 64 << 20


class StreamError(ValueError):
    """The stream isn't one that can be used."""


def as_records(rows: DataFrame, name: str, key: list[str]) -> DataFrame:
    """(value): a table's rows as lines of a stream, with ``table`` and ``id``."""
    id_ = F.concat(F.lit(f"{name}:"), F.concat_ws("/", *(F.col(k).cast("string") for k in key)))
    return rows.select(F.to_json(F.struct(F.lit(name).alias("table"), id_.alias("id"), *rows.columns)).alias("value"))


class RecordStream:
    """The stream at ``source`` (text files), with ``tables``: name -> {field: Spark type}."""

    def __init__(self, spark: SparkSession, source: str, tables: dict[str, dict[str, str]], most_bytes: int = MOST_BYTES, strict: bool = True):
        self.spark, self.tables = spark, tables
        self.path = shared_path(spark, "records")
        lines = spark.read.text(source).filter(F.trim("value") != "")
        size = F.octet_length("value")
        # What is too long isn't parsed at all.
        v = F.try_parse_json(F.when(size <= most_bytes, F.col("value")))
        text = lambda path: F.try_variant_get("v", path, "string")
        reason = (
            F.when(F.col("size") > most_bytes, "too_long").when(F.col("v").isNull() | F.schema_of_variant("v").startswith("OBJECT").eqNullSafe(False), "not_json")
            .when(~F.coalesce(text("$.table"), F.lit("")).isin(*tables), "unknown_table").when(~F.coalesce(text("$.id"), F.lit("")).startswith(F.concat(text("$.table"), F.lit(":"))), "identity_mismatch")
        )
        rows = lines.select(v.alias("v"), size.alias("size")).withColumn("reason", reason)
        rows = rows.withColumn("table", F.coalesce(F.when(F.col("reason").isNull(), text("$.table")), F.lit("errors")))
        rows.select("table", "reason", "size", "v").write.partitionBy("table").parquet(self.path)
        held = spark.read.schema("reason string, size int, v variant, `table` string").parquet(self.path)
        self.counts = {r["table"]: r["n"] for r in held.groupBy("table").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a table
        wrong = self.counts.get("errors", 0)
        if strict and wrong:
            raise StreamError(f"{source}: {wrong} records of no table, the first {held.filter('reason is not null').first()['reason']}")
        if missing := sorted(set(tables) - set(self.counts)):
            if strict:
                raise StreamError(f"{source}: no records of {missing}")

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.schema("reason string, size int, v variant, `table` string").parquet(self.path).filter(F.col("table") == name)

    def table(self, name: str, fields: list[str] | None = None) -> DataFrame:
        """Rows of a table with some of its fields, or all; a field that is absent or of another type is NULL."""
        kinds = self.tables[name]
        return self._rows(name).select(*(field("v", f, kinds[f]).alias(f) for f in (fields or list(kinds))))

    def errors(self) -> DataFrame:
        """(reason, size) of the records that belong to no table."""
        return self._rows("errors").select("reason", "size")


def field(variant: str, name: str, kind: str) -> Column:
    return F.try_variant_get(variant, f"$['{name}']", kind)
