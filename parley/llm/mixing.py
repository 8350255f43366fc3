"""Mixing sources to target weights by Poisson replication.

A document of source i is repeated a Poisson number of times whose mean is the source's target rate: its share of the
mix times the documents wanted, over the documents it has.  The count is the inverse of the Poisson distribution at a
uniform number hashed from (seed, doc_id), so a rerun, a lost executor or another partitioning gives the same mix.
Copies are shuffled globally by a second hash.

Means above ``PART`` are sums of equal independent parts, so that exp(-mean) never underflows.  A null source is a
source of its own; a null doc_id hashes as the word ``null``; rows that repeat get the same count each; a source
without a weight (or with weight 0) leaves the mix; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import free_name

SEED = 17
TEMPERATURE = 0.7
#: The largest mean that is inverted in one piece.
PART = 64.0
#: Sources up to which rates are broadcast (each some hundreds of bytes); with more, documents and rates are joined by source.
MOST_BROADCAST = 10_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def cumulative(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... until it has reached 1 in double precision."""
    most = (mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["cdf"])


def target_rates(counts: DataFrame, source: str, weights: dict | None, total_out: float | None) -> DataFrame:
    """(source, n) -> plus ``rate``, mean copies of a document.  Without weights, shares follow n ** TEMPERATURE."""
    if weights is None:
        counts = counts.withColumn("_w", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        known = [(None if k is None else str(k), float(v)) for k, v in weights.items()]
        if any(v < 0 for _, v in known):
            raise ValueError("weights must not be negative")
        table = counts.sparkSession.createDataFrame(known, "_s string, _w double")
        counts = counts.join(F.broadcast(table), counts[source].cast("string").eqNullSafe(table["_s"]), "left").drop("_s").fillna({"_w": 0.0})
    sums = counts.agg(F.sum("n").alias("n"), F.sum("_w").alias("w")).first()
    n, w = float(sums["n"] or 0), float(sums["w"] or 0)
    wanted = n if total_out is None else float(total_out)
    if not w:
        return counts.withColumn("rate", F.lit(0.0)).drop("_w")
    return counts.withColumn("rate", F.col("_w") * F.lit(wanted / w) / F.col("n")).drop("_w")


def mix_sources(docs: DataFrame, weights: dict | None = None, total_out: float | None = None, source: str = "source", doc_id: str = "doc_id", seed: int = SEED) -> tuple[DataFrame, str, str]:
    """The mix in shuffled order, with the names of the added columns: copy number (from 1) and mixing key."""
    copy, key = free_name(docs, "copy_no"), free_name(docs, "mix_key")
    own, parts, cdf, n = (free_name(docs, f"parley_{x}") for x in ("source", "parts", "cdf", "n"))
    counts = docs.groupBy(F.col(source).alias(own)).agg(F.count(F.lit(1)).alias("n"))
    rates = target_rates(counts, own, weights, total_out).filter("rate > 0")
    rates = rates.select(own, F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1)).alias(parts), "rate")
    rates = rates.select(own, parts, cumulative(F.col("rate") / F.col(parts)).alias(cdf))
    # One short row for each source: broadcast where their number is counted to be small, so documents stay where they are.
    few = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = docs.join(F.broadcast(rates) if few else rates, docs[source].eqNullSafe(rates[own]))

    def inverse(part: Column) -> Column:
        u = uniform(F.lit(seed), F.col(doc_id), part)
        return F.size(F.filter(F.col(cdf), lambda c: c <= u))

    # The first part, alone in nearly all sources, stays out of the loop.
    rest = F.when(F.col(parts) > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(F.col(parts), F.lit(2))), F.lit(0), lambda s, p: s + inverse(p))).otherwise(F.lit(0))
    rows = rows.withColumn(n, inverse(F.lit(1)) + rest).filter(F.col(n) > 0)
    rows = rows.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy))
    rows = rows.withColumn(key, F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(copy).cast("string"))), 1, 15), 16, 10).cast("bigint"))
    # The key is uniform, so hashing deals it evenly without the sampling pass of a range partitioning.
    return rows.repartition(F.col(key)).sortWithinPartitions(key), copy, key


def op3_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """One row for each copy of each document of the mix, with its place key in the global shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    mixed, copy, key = mix_sources(docs)
    return mixed.select("doc_id", "source", F.col(copy).cast("bigint").alias("copy_no"), F.col(key).alias("mix_key"))


#: DuckDB SQL for op3_mixing_sources: the same hash, rates and inverse.
OP3_SQL = f"""
with counts as (select source, count(*) as n from documents group by source),
rates as (select source, pow(n::double, {TEMPERATURE}) * (select sum(n) from counts) / (select sum(pow(n::double, {TEMPERATURE})) from counts) / n as rate from counts),
steps as (select source, k, exp(-rate) * pow(rate, k) / gamma(k + 1) as p from rates, range(0, 80) t(k)),
cdf as (select source, k, sum(p) over (partition by source order by k) as c from steps),
u as (select doc_id, source, (('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u from documents),
n as (select u.doc_id, u.source, count(*) as n from u join cdf on u.source is not distinct from cdf.source and cdf.c <= u.u group by all)
select doc_id, source, copy_no, ('0x' || substr(md5('order {SEED}:' || doc_id || ':' || copy_no), 1, 15))::bigint as mix_key
from (select doc_id, source, unnest(range(1, n + 1)) as copy_no from n)
"""
