"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets into contiguous shards.

Rows are put in the order of their key (doc_id, then size, checksum and a row number) by range partitioning, about
``ROWS`` rows a partition.  Partition totals (one short row each) give every partition its offset; a window inside
each partition adds the rest, so no row's place needs a global sort in one task.  The row number makes every key
different, so an id that a third of all rows share, or that is null, is split like any other stretch of the order.  A
document of size s that starts at byte b goes to the shard whose equal slice holds its middle, b + s / 2, so shards are
contiguous and within one document of the target.

The law is ``bytes``: equal texts are spread with their neighbours, since keeping a group that holds a third of all
rows together would break it.  Null texts have no bytes and no checksum bytes; null keys sort first; repeated rows each
get a slot; an empty table gives an empty result.  Helper columns take free names, and other columns of the input pass
through; a column that would clash with one that the function adds is an error that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import free_name, materialize

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Rows of a range partition, about.
ROWS = 100_000


def refuse_clash(df: DataFrame, added: list[str]) -> None:
    taken = {c.lower() for c in df.columns}
    if clash := [a for a in added if a.lower() in taken]:
        raise ValueError(f"the input has columns of the names {clash}, which this function adds")


def totals_before(rows: DataFrame, group: list[str], order: list[str], amounts: dict[str, str]) -> DataFrame:
    """Adds, for each new name of ``amounts``, the total of its column over the rows before in (group, order).

    A group's rows meet in one task and groups give one short row each, so the caller keeps groups of bounded size.
    """
    sums = {k: free_name(rows, f"parley_sum_{i}") for i, k in enumerate(amounts)}
    begins = {k: free_name(rows, f"parley_from_{i}") for i, k in enumerate(amounts)}
    totals = rows.groupBy(*group).agg(*(F.sum(v).alias(sums[k]) for k, v in amounts.items()))
    before = W.orderBy(*group).rowsBetween(W.unboundedPreceding, -1)  # one row a group
    offsets = totals.select(*group, *(F.coalesce(F.sum(sums[k]).over(before), F.lit(0)).alias(begins[k]) for k in amounts))
    inside = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = {k: free_name(rows, f"parley_in_{i}") for i, k in enumerate(amounts)}
    out = rows.withColumns({own[k]: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in amounts.items()})
    out = out.join(F.broadcast(offsets), group)  # one short row a group of some 100,000 rows
    return out.withColumns({k: F.col(begins[k]) + F.col(own[k]) for k in amounts}).drop(*begins.values(), *own.values())


def running_totals(df: DataFrame, order: list[str], amounts: dict[str, Column], rows_each: int = ROWS) -> DataFrame:
    """Adds, for each name of ``amounts``, the total of the rows before this one in ``order`` (nulls first; ties in one order)."""
    refuse_clash(df, list(amounts))
    tie, part = free_name(df, "parley_tie"), free_name(df, "parley_part")
    values = {k: free_name(df, f"parley_amount_{i}") for i, k in enumerate(amounts)}
    rows = materialize(df.withColumns({values[k]: v for k, v in amounts.items()} | {tie: F.monotonically_increasing_id()}), "amounts")
    n = max(1, -(-rows.count() // rows_each))
    # The partition of a row is written, so that totals and windows agree.
    rows = materialize(rows.repartitionByRange(n, *order, tie).withColumn(part, F.spark_partition_id()), "ranges")
    return totals_before(rows, [part], [*order, tie], {k: values[k] for k in amounts}).drop(tie, part, *values.values())


def assign_shards(sized: DataFrame, n_shards: int, order: list[str], rows_each: int = ROWS) -> DataFrame:
    """``sized`` (with a ``size`` column) plus ``shard`` and ``slot``; nothing but the given columns is shuffled."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    refuse_clash(sized, ["shard", "slot"])
    before, rank, first = (free_name(sized, f"parley_{x}") for x in ("before", "rank", "first"))
    total = sized.agg(F.sum("size")).first()[0] or 1
    rows = running_totals(sized, order, {before: F.col("size"), rank: F.lit(1).cast("bigint")}, rows_each)
    middle = f"(2 * cast(`{before}` as decimal(38, 0)) + size)"
    shard = F.least(F.lit(n_shards - 1), F.expr(f"cast({middle} * {n_shards} div (2 * cast({total} as decimal(38, 0))) as int)"))
    rows = rows.withColumn("shard", shard)
    firsts = rows.groupBy("shard").agg(F.min(rank).alias(first))
    rows = rows.join(F.broadcast(firsts), "shard")  # n_shards rows
    return rows.select(*sized.columns, "shard", (F.col(rank) - F.col(first)).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    # Three short numbers a row, written once: the texts are read a single time.
    out = assign_shards(materialize(sized, "sizes"), 40, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
