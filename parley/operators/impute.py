"""Waits imputed from nearest donors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.storage import settled

NEIGHBOURS, SAME_MODEL, SAME_VENDOR = 15, 8, 30


def _beside(asked: DataFrame, offers: DataFrame) -> DataFrame:
    """asked: targets, each with lines (f1) of its pool -> the columns of a target with its nearest donors on these lines."""
    at = ["pool", "f1", "f2", "dialogue_id"]
    marks = asked.select("pool", "f1", F.col("t2").alias("f2"), "dialogue_id").withColumn("one", F.lit(0))
    both = marks.unionByName(offers.select("pool", "f1", "f2", F.lit(None).cast(asked.schema["dialogue_id"].dataType).alias("dialogue_id"), F.lit(1).alias("one")))
    # Donors under the target; those equal to it are above.
    count = F.sum("one").over(W.partitionBy("pool", "f1").orderBy("f2", "one").rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("n", count.cast("int")).filter("one = 0").select(*at, "n")
    sides = []
    for side, first in (("below", F.col("n") - NEIGHBOURS + 1), ("above", F.col("n") + 1)):
        wanted = placed.select("pool", "f1", "dialogue_id", F.explode(F.sequence(first, first + NEIGHBOURS - 1)).alias(side))
        sides.append(wanted.join(offers.select("pool", "f1", side, F.col("f2").alias("x2"), "donor", "per_call"), ["pool", "f1", side]).drop(side))
    found = sides[0].unionByName(sides[1]).join(asked.drop("f1", "pool").distinct(), "dialogue_id")
    found = found.withColumn("d", F.hypot(F.col("t1") - F.col("f1"), F.col("t2") - F.col("x2")))
    return found.withColumn("r", F.row_number().over(W.partitionBy("dialogue_id").orderBy("d", "donor"))).filter(F.col("r") <= NEIGHBOURS)


def impute_waits(dialogues: DataFrame) -> DataFrame:
    """dialogues(dialogue_id, calls, output, wait_ms, api_ms, model) -> an estimate for each row without a wait.

    Donors share the model if 8 or more do, else the vendor if 30 or more do, else all serve.  The 15 nearest by
    log calls and log output a call are weighted by inverse squared distance; waits a call are averaged in logarithms.
    Donors of a pool with the same calls lie on a line, on which a target's nearest stand beside it; its own line bounds how far
    other lines may be.  Cost grows with rows times the lines within that bound, not with pairs.
    """
    f1 = F.log1p(F.greatest("calls", F.lit(1)).cast("double")) * 0.35
    f2 = F.log1p(F.col("output") / F.greatest("calls", F.lit(1))) * 0.65
    rows = dialogues.withColumns({"f1": f1, "f2": f2, "vendor": F.when(F.col("model").contains("/"), F.substring_index("model", "/", 1)).otherwise("unknown")})
    donors = rows.filter("wait_ms > 0").withColumn("per_call", F.greatest("wait_ms", F.lit(1)) / F.greatest("calls", F.lit(1)))
    targets = rows.filter("wait_ms is null or wait_ms <= 0")
    by_model = donors.groupBy("model").agg(F.count(F.lit(1)).alias("n_model")).filter(f"n_model >= {SAME_MODEL}")
    by_vendor = donors.filter("vendor <> 'unknown'").groupBy("vendor").agg(F.count(F.lit(1)).alias("n_vendor")).filter(f"n_vendor >= {SAME_VENDOR}")
    targets = targets.join(by_model, "model", "left").join(by_vendor, "vendor", "left")
    source = F.when(F.col("n_model").isNotNull(), "same_model").when(F.col("n_vendor").isNotNull(), "same_vendor").otherwise("global")
    pool = F.when(F.col("n_model").isNotNull(), F.concat(F.lit("m:"), "model")).when(F.col("n_vendor").isNotNull(), F.concat(F.lit("v:"), "vendor")).otherwise("all")
    targets = targets.select("dialogue_id", F.greatest("calls", F.lit(1)).alias("t_calls"), "api_ms", F.col("f1").alias("t1"), F.col("f2").alias("t2"), source.alias("source"), pool.alias("pool"))
    pools = F.array(F.concat(F.lit("m:"), "model"), F.concat(F.lit("v:"), "vendor"), F.lit("all"))
    offers = donors.select(F.explode(pools).alias("pool"), F.col("dialogue_id").alias("donor"), "f1", "f2", "per_call").filter("pool is not null")
    # Sides of a target: ties of f2 are taken in the order of donors, whichever side they are on.
    line = W.partitionBy("pool", "f1")
    offers = offers.withColumns({"below": F.row_number().over(line.orderBy("f2", F.desc("donor"))), "above": F.row_number().over(line.orderBy("f2", "donor"))})
    offers, targets = settled(offers, "donors"), settled(targets, "targets")
    own = _beside(targets.withColumn("f1", F.col("t1")), offers)
    bound = own.groupBy("dialogue_id").agg(F.when(F.count(F.lit(1)) == NEIGHBOURS, F.max("d")).alias("bound"))
    reach = targets.join(bound, "dialogue_id", "left").join(offers.select("pool", "f1").distinct(), "pool")
    near = _beside(reach.filter("bound is null or abs(t1 - f1) <= bound * 1.000001 + 1e-12").drop("bound"), offers)
    weight = 1 / F.pow(0.15 + F.col("d"), F.lit(2.0))
    g = near.withColumn("w", weight).groupBy("dialogue_id", "source", "t_calls", "api_ms").agg(
        F.exp(F.sum(F.col("w") * F.ln("per_call")) / F.sum("w")).alias("each"), F.count(F.lit(1)).alias("donors"),
        F.expr("percentile_disc(0.2) within group (order by per_call)").alias("low"), F.expr("percentile_disc(0.8) within group (order by per_call)").alias("high"),
    )
    ms = F.greatest(F.col("api_ms").cast("double"), F.col("each") * F.col("t_calls"))
    floor = lambda c: F.greatest(F.col("api_ms").cast("double"), F.col(c) * F.col("t_calls"))
    return g.select("dialogue_id", "source", "donors", F.round(ms, 3).alias("ms"), F.round(F.least(ms, floor("low")), 3).alias("lower_ms"), F.round(F.greatest(ms, floor("high")), 3).alias("upper_ms"))
