"""Usage, timing and cost reports over message facts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import numbers as N
from parley.functions import texts as T
from parley.functions.models import LONG_CONTEXT, price_rows, price_table, with_cost
from parley.operators import sequences as S
from parley.operators import usage as U
from parley.operators.percentiles import nearest_ranks
from parley.operators.storage import settled
from parley.plans.tables import MSG, messages, query

_pos = lambda c: f"greatest(coalesce({c}, 0), 0)"
_I, _R, _W = _pos("input_tokens"), _pos("cached_tokens"), _pos("write_tokens")
_VALID = f"has_usage and {_R} + {_W} <= {_I}"
_sum = lambda x, when="true": f"cast(coalesce(sum({x}) filter (where {when}), 0) as bigint)"
SQL_MEASURES = {
    "messages": "count(*)", "responses": "count(model_key)", "content_chars": _sum("content_chars"),
    "assistant_chars": _sum("content_chars", "role = 'assistant'"), "user_chars": _sum("content_chars", "role = 'user'"), "tool_chars": _sum("content_chars", "role = 'tool'"),
    "usage_messages": "count(*) filter (where has_usage)", "estimated_usage_messages": "count(*) filter (where is_estimated)",
    "input_tokens": _sum(_I, "has_usage"), "cached_tokens": _sum(_R, "has_usage"), "write_tokens": _sum(_W, "has_usage"),
    "uncached_tokens": _sum(f"{_I} - {_R} - {_W}", _VALID), "breakdown_input_tokens": _sum(_I, _VALID),
    "classified_cached_tokens": _sum(_R, _VALID), "classified_write_tokens": _sum(_W, _VALID), "breakdown_messages": f"count(*) filter (where {_VALID})",
    "invalid_breakdown_messages": f"count(*) filter (where has_usage and not ({_R} + {_W} <= {_I}))",
    "output_tokens": _sum("output_tokens", "has_usage"), "reasoning_tokens": _sum("reasoning_tokens", "has_usage"), "total_tokens": _sum("total_tokens", "has_usage"),
    "duration_count": "count(*) filter (where duration_ms > 0)", "duration_ms": _sum("duration_ms", "duration_ms > 0"), "ttft_count": "count(*) filter (where ttft_ms > 0)",
    "reported_count": "count(*) filter (where reported_ms > 0)", "reported_ms": _sum("reported_ms", "reported_ms > 0"),
    "reported_cost_messages": "count(*) filter (where cost > 0)", "reported_cost": "round(coalesce(sum(cost) filter (where cost > 0), 0), 6)",
}


def acc_sql(*keys: str, where: str = "true") -> str:
    cols = ", ".join([*keys, *(f"{v} as {k}" for k, v in SQL_MEASURES.items()), "count(distinct dialogue_id) as dialogues"])
    return f"select {cols} from msg where {where} group by {', '.join(keys)}" if keys else f"select {cols} from msg where {where}"


@query("agg_01_usage_accumulator", f"with {MSG} {acc_sql('dialogue_id')}")
def agg_01(spark, d):
    return U.accumulate(messages(spark, d), "dialogue_id")


@query("agg_03_by_harness", f"with {MSG} {acc_sql('harness')}")
def agg_03(spark, d):
    return U.accumulate(messages(spark, d), "harness")


@query("agg_04_by_model", f"with {MSG} {acc_sql('model_key', where='model_key is not null')}")
def agg_04(spark, d):
    return U.accumulate(messages(spark, d).filter("model_key is not null"), "model_key")


@query("agg_05_by_model_harness", f"with {MSG} {acc_sql('model_key', 'harness', where='model_key is not null')}")
def agg_05(spark, d):
    return U.accumulate(messages(spark, d).filter("model_key is not null"), "model_key", "harness")


@query("agg_06_by_role", f"with {MSG} select role, count(*) as messages, {_sum('content_chars')} as content_chars, {_sum('total_tokens')} as tokens, round(sum(content_chars) / count(*), 6) as avg_chars from msg group by role")
def agg_06(spark, d):
    g = messages(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum("content_chars").alias("content_chars"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
    return g.withColumn("avg_chars", F.round(F.col("content_chars") / F.col("messages"), 6))


_RATES = """round(case when input_tokens > 0 then breakdown_input_tokens / input_tokens end, 6) as breakdown_coverage,
 round(case when usage_messages > 0 then total_tokens / usage_messages end, 6) as tokens_per_usage_message,
 round(case when usage_messages > 0 then output_tokens / usage_messages end, 6) as output_per_usage_message,
 round(case when total_tokens > 0 then output_tokens / total_tokens end, 6) as output_share,
 round(case when output_tokens > 0 then reasoning_tokens / output_tokens end, 6) as reasoning_share,
 round(case when input_tokens > 0 and cached_tokens <= input_tokens then cached_tokens / input_tokens end, 6) as cache_share,
 round(case when input_tokens > 0 then cached_tokens / input_tokens end, 6) as raw_cache_ratio,
 round(case when total_tokens > 0 then content_chars * 1000.0::double / total_tokens end, 6) as chars_per_1k_tokens,
 round(duration_ms / 3600000, 6) as duration_hours,
 round(case when responses > 0 then duration_count / responses end, 6) as duration_coverage,
 round(case when responses > 0 then reported_cost_messages / responses end, 6) as reported_cost_coverage"""


@query("agg_07_group_finalizer", f"with {MSG}, g as ({acc_sql('model_key', where='model_key is not null')}) select g.*, {_RATES} from g")
def agg_07(spark, d):
    return U.finalize(U.accumulate(messages(spark, d).filter("model_key is not null"), "model_key"))


@query("agg_08_distinct_entities", f"with {MSG} select workspace, count(distinct dialogue_id) as dialogues, count(distinct turn_id) as turns, count(distinct model_key) as models from msg group by workspace")
def agg_08(spark, d):
    return messages(spark, d).groupBy("workspace").agg(F.countDistinct("dialogue_id").alias("dialogues"), F.countDistinct("turn_id").alias("turns"), F.countDistinct("model_key").alias("models"))


_PCT = ", ".join(f"percentile_disc({p / 100}) within group (order by case when {c} > 0 then {c} end)::double as {c}_p{p}" for c in ("duration_ms", "ttft_ms", "reported_ms") for p in (50, 90))


@query("agg_09_nearest_rank_percentiles", f"with {MSG} select model_key, {_PCT} from msg where model_key is not null group by model_key")
def agg_09(spark, d):
    """Three figures of a model's messages: each is a group of its own, and all are ranked in one pass."""
    figures = ("duration_ms", "ttft_ms", "reported_ms")
    m = messages(spark, d).filter("model_key is not null").select("model_key", *figures)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.when(F.col(c) > 0, F.col(c)).alias("x")) for c in figures)))
    ranks = nearest_ranks(m.select("model_key", pairs.alias("f")).select("model_key", "f.*"), ["model_key", "figure"], "x", {"p50": 0.5, "p90": 0.9})
    wide = ranks.groupBy("model_key").agg(*(F.max(F.when(F.col("figure") == c, F.col(p))).alias(f"{c}_{p}") for c in figures for p in ("p50", "p90")))
    return m.select("model_key").distinct().join(wide, "model_key", "left")


@query("agg_10_lower_quantile_levels", f"""with {MSG}, days as (select harness, cast(ts as date) as day, cast(sum(coalesce(total_tokens, 0)) as bigint) as tokens from msg group by all),
 l as (select harness, list_sort(list(tokens)) as v from days where tokens > 0 group by harness)
 select harness, {', '.join(f'v[cast(floor((len(v) - 1) * {q}) as bigint) + 1] as q{int(q * 100)}' for q in (0.2, 0.4, 0.6, 0.8))} from l""")
def agg_10(spark, d):
    days = messages(spark, d).groupBy("harness", F.to_date("ts").alias("day")).agg(F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens")).filter("tokens > 0")
    v = days.groupBy("harness").agg(F.sort_array(F.collect_list("tokens")).alias("v"))
    return v.select("harness", *(N.lower_quantile(F.col("v"), q).alias(f"q{int(q * 100)}") for q in (0.2, 0.4, 0.6, 0.8)))


_TURNS = """t as (select {keys}, coalesce(dialogue_id || ':' || wait_turn, 'm' || message_id) as turn, max(wait_ms) as wait_ms from msg where human_authored and wait_ms > 0 group by all)"""


@query("agg_11_max_then_sum_waits", f"with {MSG}, {_TURNS.format(keys='harness')} select harness, count(*) as wait_turns, cast(sum(wait_ms) as bigint) as wait_ms, percentile_disc(0.5) within group (order by wait_ms)::double as wait_p50, percentile_disc(0.9) within group (order by wait_ms)::double as wait_p90 from t group by harness")
def agg_11(spark, d):
    return U.wait_sums(messages(spark, d), "harness")


@query("agg_12_argmax_label", f"with {MSG}, b as (select model_key, harness, count(*) as n from msg where model_key is not null group by all), c as (select *, row_number() over (partition by model_key order by n desc, harness) as r from b) select model_key, harness as top_harness, n as top_messages from c where r = 1")
def agg_12(spark, d):
    c = messages(spark, d).filter("model_key is not null").groupBy("model_key", "harness").agg(F.count(F.lit(1)).alias("n"))
    return S.first_by(c, ["model_key"], [F.desc("n"), F.asc("harness")]).select("model_key", F.col("harness").alias("top_harness"), F.col("n").alias("top_messages"))


@query("agg_13_dominant_model", f"""with {MSG}, m as (select dialogue_id, model_key, cast(sum(coalesce(total_tokens, 0)) as bigint) as tokens, count(*) as responses, min(sequence) as first_seen from msg where model_key is not null group by all),
 r as (select *, row_number() over (partition by dialogue_id order by tokens desc, responses desc, first_seen, model_key) as r from m where tokens > 0 or responses > 0)
 select dialogue_id, model_key as dominant_model, tokens, responses from r where r = 1""")
def agg_13(spark, d):
    m = messages(spark, d).filter("model_key is not null").groupBy("dialogue_id", "model_key")
    m = m.agg(F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("responses"), F.min("sequence").alias("first_seen"))
    top = S.first_by(m, ["dialogue_id"], [F.desc("tokens"), F.desc("responses"), F.asc("first_seen"), F.asc("model_key")])
    return top.select("dialogue_id", F.col("model_key").alias("dominant_model"), "tokens", "responses")


@query("agg_14_primary_model", f"""with {MSG}, m as (select dialogue_id, model_key, count(*) as n, max(sequence) as last_seen from msg where model_key is not null group by all),
 r as (select *, row_number() over (partition by dialogue_id order by n desc, last_seen desc, model_key) as r from m) select dialogue_id, model_key as primary_model, n from r where r = 1""")
def agg_14(spark, d):
    m = messages(spark, d).filter("model_key is not null").groupBy("dialogue_id", "model_key").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last_seen"))
    return S.first_by(m, ["dialogue_id"], [F.desc("n"), F.desc("last_seen"), F.asc("model_key")]).select("dialogue_id", F.col("model_key").alias("primary_model"), "n")


@query("agg_15_tool_ranking", f"""with {MSG}, t as (select tool_name, count(*) as calls, count(distinct dialogue_id) as sessions from msg where tool_name is not null group by tool_name),
 b as (select tool_name, harness, count(*) as n from msg where tool_name is not null group by all), h as (select *, row_number() over (partition by tool_name order by n desc, harness) as r from b)
 select t.*, h.harness as top_harness, row_number() over (order by calls desc, t.tool_name) as rank from t join h on t.tool_name = h.tool_name and r = 1""")
def agg_15(spark, d):
    m = messages(spark, d).filter("tool_name is not null")
    t = m.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("dialogue_id").alias("sessions"))
    h = S.first_by(m.groupBy("tool_name", "harness").count(), ["tool_name"], [F.desc("count"), F.asc("harness")]).select("tool_name", F.col("harness").alias("top_harness"))
    return t.join(h, "tool_name").withColumn("rank", F.row_number().over(W.orderBy(F.desc("calls"), "tool_name")).cast("bigint"))


@query("agg_16_kpi_row", f"with {MSG}, g as ({acc_sql()}) select g.*, {_RATES} from g")
def agg_16(spark, d):
    return U.finalize(U.accumulate(messages(spark, d)))


@query("agg_17_predicate_counts", f"with {MSG} select count(*) as n, count(*) filter (where human_authored) as human, count(*) filter (where visible) as visible, count(*) filter (where has_usage and not is_estimated) as exact_usage, count(*) filter (where wait_ms is null) as no_wait from msg")
def agg_17(spark, d):
    return messages(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if("human_authored").alias("human"), F.count_if("visible").alias("visible"), F.count_if(F.col("has_usage") & ~F.col("is_estimated")).alias("exact_usage"), F.count_if(F.col("wait_ms").isNull()).alias("no_wait"))


@query("agg_20_token_plan", f"with {MSG} select count(*) as segments, cast(sum(content_chars) as bigint) as chars, count(*) filter (where content_chars > 1500) as over_target, cast(sum(ceil(content_chars / 3.5)) as bigint) as tokens from msg")
def agg_20(spark, d):
    return messages(spark, d).agg(F.count(F.lit(1)).alias("segments"), F.sum("content_chars").alias("chars"), F.count_if(F.col("content_chars") > 1500).alias("over_target"), F.sum(F.ceil(F.col("content_chars") / 3.5)).alias("tokens"))


@query("agg_25_token_summary", f"with {MSG} select cast(sum(input_tokens) as bigint) as total, max(input_tokens) as largest, count(*) filter (where input_tokens > 6500) as over_6500, count(*) filter (where input_tokens > 8000) as over_8000, count(*) filter (where input_tokens >= 8192) as at_8192 from msg")
def agg_25(spark, d):
    t = F.col("input_tokens")
    return messages(spark, d).agg(F.sum(t).alias("total"), F.max(t).alias("largest"), F.count_if(t > 6500).alias("over_6500"), F.count_if(t > 8000).alias("over_8000"), F.count_if(t >= 8192).alias("at_8192"))


_SLICES = "with {m}, s as (select *, unnest(['all', 'harness:' || harness, 'role:' || role]) as slice from msg)"


@query("agg_27_multi_slice", _SLICES.format(m=MSG) + " select slice, count(*) as n, round(avg(content_chars), 6) as mean_chars, percentile_disc(0.5) within group (order by content_chars)::double as p50, percentile_disc(0.95) within group (order by content_chars)::double as p95, max(content_chars) as most from s group by slice")
def agg_27(spark, d):
    s = messages(spark, d).select(F.explode(F.array(F.lit("all"), F.concat(F.lit("harness:"), "harness"), F.concat(F.lit("role:"), "role"))).alias("slice"), "content_chars")
    return s.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("content_chars"), 6).alias("mean_chars"), N.nearest_rank("content_chars", 0.5).alias("p50"), N.nearest_rank("content_chars", 0.95).alias("p95"), F.max("content_chars").alias("most"))


@query("agg_28_model_contrasts", f"""with {MSG}, g as (select model_key, harness, count(*) filter (where has_usage) as used, round(avg(duration_ms) filter (where duration_ms > 0), 6) as mean_ms from msg where model_key is not null group by all),
 e as (select * from g where used >= 3 and mean_ms is not null), f as (select *, row_number() over (partition by model_key order by mean_ms, harness) as lo, row_number() over (partition by model_key order by mean_ms desc, harness) as hi from e)
 select model_key, count(*) as harnesses, min(mean_ms) as min_ms, max(mean_ms) as max_ms, round(max(mean_ms) / min(mean_ms), 6) as ratio, max(harness) filter (where lo = 1) as fastest, max(harness) filter (where hi = 1) as slowest from f group by model_key having count(*) >= 2""")
def agg_28(spark, d):
    m = messages(spark, d).filter("model_key is not null")
    g = m.groupBy("model_key", "harness").agg(F.count_if("has_usage").alias("used"), F.round(F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))), 6).alias("mean_ms"))
    g = g.filter("used >= 3 and mean_ms is not null")
    out = g.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("harnesses"), F.min("mean_ms").alias("min_ms"), F.max("mean_ms").alias("max_ms"), F.round(F.max("mean_ms") / F.min("mean_ms"), 6).alias("ratio"),
        F.min(F.struct("mean_ms", "harness"))["harness"].alias("fastest"), F.min(F.struct(-F.col("mean_ms"), "harness"))["harness"].alias("slowest"),
    )
    return out.filter("harnesses >= 2")


_BUCKETS = (10_000, 30_000, 60_000, 80_000, 95_000)


@query("agg_29_wait_buckets", f"with {MSG}, {_TURNS.format(keys='harness')}, b as (select {' + '.join(f'(wait_ms >= {x})::int' for x in _BUCKETS)} as bucket, wait_ms from t) select cast(bucket as bigint) as bucket, count(*) as turns, cast(sum(wait_ms) as bigint) as wait_ms from b group by bucket")
def agg_29(spark, d):
    t = U.turn_waits(messages(spark, d), "harness")
    b = sum((F.when(F.col("wait_ms") >= x, 1).otherwise(0) for x in _BUCKETS[1:]), F.when(F.col("wait_ms") >= _BUCKETS[0], 1).otherwise(0))
    return t.groupBy(b.cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("turns"), F.sum("wait_ms").alias("wait_ms"))


@query("agg_30_shared_turns", f"with {MSG} select turn_id, count(distinct model_key) as models, count(*) as n from msg group by turn_id having count(distinct model_key) > 1")
def agg_30(spark, d):
    # A turn names few models: a set of them a turn needs one grouping, a distinct count four, all held by one task.
    return messages(spark, d).groupBy("turn_id").agg(F.size(F.collect_set("model_key")).cast("bigint").alias("models"), F.count(F.lit(1)).alias("n")).filter("models > 1")


@query("agg_31_inflation_check", f"with {MSG}, g as (select turn_id, cast(sum(total_tokens) as bigint) as summed, max(total_tokens) as largest from msg where has_usage group by turn_id) select turn_id, summed, largest, round(summed / largest, 6) as ratio from g where largest > 0 and summed > 1.2::double * largest")
def agg_31(spark, d):
    g = messages(spark, d).filter("has_usage").groupBy("turn_id").agg(F.sum("total_tokens").alias("summed"), F.max("total_tokens").alias("largest"))
    return g.filter((F.col("largest") > 0) & (F.col("summed") > F.lit(1.2) * F.col("largest"))).withColumn("ratio", F.round(F.col("summed") / F.col("largest"), 6))


@query("flt_05_answered_dialogues", f"with {MSG} select distinct dialogue_id from msg where role = 'assistant' and visible and (content_chars > 0 or coalesce(output_tokens, 0) > 0)")
def flt_05(spark, d):
    return messages(spark, d).filter((F.col("role") == "assistant") & F.col("visible") & ((F.col("content_chars") > 0) | (N.positive(F.col("output_tokens")) > 0))).select("dialogue_id").distinct()


@query("flt_12_scatter_points", f"with {MSG}, g as (select dialogue_id, round(coalesce(sum(cost), 0), 6) as x, cast(coalesce(sum(output_tokens), 0) as bigint) as y from msg group by dialogue_id) select * from g where x > 0 and y > 0")
def flt_12(spark, d):
    g = messages(spark, d).groupBy("dialogue_id").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("x"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("y"))
    return g.filter("x > 0 and y > 0")


_PRICES = ", ".join(f"('{k}', {a}::bigint, {b}::bigint, {i}::double, {c}::double, {w}::double, {o}::double)" for k, a, b, i, c, w, o in price_rows())
_LONG = f"(input_tokens > 272000 and model_key in ({', '.join(repr(m) for m in LONG_CONTEXT)}))"
_COST = f"""price(mk, above, upto, pi, pc, pw, po) as (values {_PRICES}),
 c as (select msg.*, mk is not null as priced,
  coalesce(case when {_R} + {_W} <= {_I} then {_I} - {_R} - {_W} else {_I} end * pi * case when {_LONG} then 2 else 1 end / 1e6, 0) as input_cost,
  coalesce(case when {_R} + {_W} <= {_I} then {_R} else 0 end * pc * case when {_LONG} then 2 else 1 end / 1e6, 0) as cached_cost,
  coalesce(case when {_R} + {_W} <= {_I} then {_W} else 0 end * pw * case when {_LONG} then 2 else 1 end / 1e6, 0) as write_cost,
  coalesce(output_tokens * po * case when {_LONG} then 1.5 else 1 end / 1e6, 0) as output_cost
  from msg left join price on model_key = mk and input_tokens > above and input_tokens <= upto where has_usage and model_key is not null)"""


_COSTS = ("input_cost", "cached_cost", "write_cost", "output_cost")


@query("scl_03_token_cost", f"with {MSG}, {_COST} select model_key, count(*) as n, count(*) filter (where priced) as priced_n, {', '.join(f'cast(sum(cast(round({c} * 1e9) as bigint)) as bigint) as {c}_nano' for c in _COSTS)}, cast(sum(case when priced then 0 else input_tokens + output_tokens end) as bigint) as unpriced_tokens from c group by model_key")
def scl_03(spark, d):
    """Costs by model in billionths of a dollar, so that sums are exact in any order."""
    m = with_cost(messages(spark, d).filter("has_usage and model_key is not null"), price_table(spark), "model_key", "input_tokens", "cached_tokens", "write_tokens", "output_tokens")
    nano = lambda c: F.sum(F.round(F.col(c) * 1e9).cast("bigint")).alias(f"{c}_nano")
    return m.groupBy("model_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("priced").alias("priced_n"), *(nano(c) for c in _COSTS), F.sum("unpriced_tokens").alias("unpriced_tokens"))


@query("win_10_first_day_turns", f"""with {MSG}, t as (select coalesce(dialogue_id || ':' || wait_turn, 'm' || message_id) as turn, cast(ts as date) as day, max(wait_ms) as w from msg where human_authored and wait_ms > 0 group by all),
 f as (select *, row_number() over (partition by turn order by day) as r from t) select strftime(day, '%Y-%m-%d') as day, count(*) as turns, cast(sum(w) as bigint) as wait_ms from f where r = 1 group by day""")
def win_10(spark, d):
    t = U.turn_waits(messages(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")
    return S.first_by(t, ["turn"], ["day"]).groupBy("day").agg(F.count(F.lit(1)).alias("turns"), F.sum("wait_ms").alias("wait_ms"))


@query("win_11_rank_with_ties", f"with {MSG}, c as (select workspace, tool_name, count(*) as calls from msg where tool_name is not null group by all) select workspace, tool_name, calls, row_number() over (partition by workspace order by calls desc, tool_name) as rank from c")
def win_11(spark, d):
    c = messages(spark, d).filter("tool_name is not null").groupBy("workspace", "tool_name").agg(F.count(F.lit(1)).alias("calls"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("workspace").orderBy(F.desc("calls"), "tool_name")).cast("bigint"))


@query("win_19_proportional_days", f"""with {MSG}, d as (select dialogue_id, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m') as month, count(*) as n from msg group by all)
 select dialogue_id, month, n, round(n / sum(n) over (partition by dialogue_id), 6) as share from d""")
def win_19(spark, d):
    g = messages(spark, d).groupBy("dialogue_id", T.month_key(T.day_key(F.col("ts"))).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("dialogue_id")), 6))


@query("rpt_01_daily", f"""with {MSG} select strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m-%d') as day, count(*) as messages, count(distinct dialogue_id) as sessions, count(*) filter (where has_usage) as usage_messages,
 {_sum('input_tokens')} as input_tokens, {_sum('output_tokens')} as output_tokens, {_sum('total_tokens')} as total_tokens, {_sum('content_chars')} as content_chars, {_sum('duration_ms')} as duration_ms from msg group by day""")
def rpt_01(spark, d):
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    m = messages(spark, d).withColumn("day", T.day_key(F.col("ts")))
    return m.groupBy("day").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("dialogue_id").alias("sessions"), F.count_if("has_usage").alias("usage_messages"), *(zero(c) for c in ("input_tokens", "output_tokens", "total_tokens", "content_chars", "duration_ms")))


@query("rpt_02_monthly_breakdown", f"""with {MSG}, x as (select strftime(ts, '%Y-%m') as month, unnest([struct_pack(dim := 'project', k := workspace), struct_pack(dim := 'harness', k := harness), struct_pack(dim := 'vendor', k := coalesce(split_part(model_key, '/', 1), 'unknown'))]) as s, total_tokens, dialogue_id from msg)
 select month, s.dim as dim, s.k as key, count(*) as messages, cast(coalesce(sum(total_tokens), 0) as bigint) as tokens, count(distinct dialogue_id) as dialogues from x group by all""")
def rpt_02(spark, d):
    pair = lambda dim, k: F.struct(F.lit(dim).alias("dim"), k.alias("key"))
    keys = F.array(pair("project", F.col("workspace")), pair("harness", F.col("harness")), pair("vendor", F.coalesce(F.substring_index("model_key", "/", 1), F.lit("unknown"))))
    x = messages(spark, d).select(F.date_format("ts", "yyyy-MM").alias("month"), F.explode(keys).alias("s"), "total_tokens", "dialogue_id")
    return x.groupBy("month", "s.dim", "s.key").agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.countDistinct("dialogue_id").alias("dialogues"))


@query("rpt_03_monthly_rollup", f"""with {MSG}, d as (select strftime(ts, '%Y-%m-%d') as day, count(*) as n, cast(coalesce(sum(total_tokens), 0) as bigint) as tokens from msg group by day),
 p as (select strftime(ts, '%Y-%m') as month, count(distinct workspace) as projects from msg group by month)
 select substr(day, 1, 7) as month, count(*) as days, cast(sum(n) as bigint) as messages, cast(sum(tokens) as bigint) as tokens, max(tokens) as busiest, any_value(projects) as projects from d join p on substr(day, 1, 7) = month group by substr(day, 1, 7)""")
def rpt_03(spark, d):
    m = messages(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    days = m.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")).withColumn("month", T.month_key(F.col("day")))
    projects = m.groupBy(T.month_key(F.col("day")).alias("month")).agg(F.countDistinct("workspace").alias("projects"))
    return days.groupBy("month").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("messages"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("busiest")).join(projects, "month")


@query("rpt_04_session_points", f"""with {MSG}, {_TURNS.format(keys='dialogue_id')}, w as (select dialogue_id, cast(sum(wait_ms) as bigint) as wait from t group by dialogue_id)
 select dialogue_id, count(*) as messages, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 as elapsed_ms, {_sum('total_tokens')} as tokens, {_sum('duration_ms')} as api_ms, coalesce(any_value(wait), 0) as wait_ms,
 case when coalesce(any_value(wait), 0) > 0 then any_value(wait) else {_sum('duration_ms')} end as active_ms from msg left join w using (dialogue_id) group by dialogue_id""")
def rpt_04(spark, d):
    m = messages(spark, d)
    waits = U.turn_waits(m, "dialogue_id").groupBy("dialogue_id").agg(F.sum("wait_ms").alias("wait"))
    g = m.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("messages"), (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("elapsed_ms"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("api_ms"))
    g = g.join(waits, "dialogue_id", "left").withColumn("wait_ms", F.coalesce("wait", F.lit(0))).drop("wait")
    return g.withColumn("active_ms", N.effective_active_ms(F.lit(0), F.col("api_ms"), F.col("wait_ms")))


_HARNESSES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("rpt_06_model_harness_pivot", f"with {MSG} select model_key, {', '.join(f'''cast(sum(total_tokens) filter (where harness = '{h}') as bigint) as {h.lower().replace(' ', '_')}''' for h in _HARNESSES)} from msg where model_key is not null group by model_key")
def rpt_06(spark, d):
    p = messages(spark, d).filter("model_key is not null").groupBy("model_key").pivot("harness", list(_HARNESSES)).sum("total_tokens")
    return p.select("model_key", *(F.col(f"`{h}`").alias(h.lower().replace(" ", "_")) for h in _HARNESSES))


@query("rpt_07_token_mix", f"""with {MSG}, g as ({acc_sql('model_key', where='model_key is not null')}) select model_key, total_tokens, round(uncached_tokens / nullif(breakdown_input_tokens + output_tokens, 0), 6) as uncached_share, round(classified_cached_tokens / nullif(breakdown_input_tokens + output_tokens, 0), 6) as cached_share,
 round(classified_write_tokens / nullif(breakdown_input_tokens + output_tokens, 0), 6) as write_share, round(output_tokens / nullif(breakdown_input_tokens + output_tokens, 0), 6) as output_share from g order by total_tokens desc, model_key limit 16""")
def rpt_07(spark, d):
    g = U.accumulate(messages(spark, d).filter("model_key is not null"), "model_key")
    whole = F.col("breakdown_input_tokens") + F.col("output_tokens")
    share = lambda c, n: N.round6(N.ratio(F.col(c), whole)).alias(n)
    g = g.select("model_key", "total_tokens", share("uncached_tokens", "uncached_share"), share("classified_cached_tokens", "cached_share"), share("classified_write_tokens", "write_share"), share("output_tokens", "output_share"))
    return g.orderBy(F.desc("total_tokens"), "model_key").limit(16)


@query("scl_11_timing_quality", f"""with {MSG}, s as (select dialogue_id, count(*) as n, cast(coalesce(sum(wait_ms) filter (where human_authored), 0) as bigint) as wait, cast(coalesce(sum(duration_ms), 0) as bigint) as api, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 as span, count(distinct ts) / count(*) as uniq from msg group by dialogue_id)
 select dialogue_id, case when n >= 500 and api = 0 and span <= 900000 and uniq < 0.25 then 'timestamp_replay_suspect' when wait > 0 then case when span > 0 then 'mixed_response_wait_and_gap' else 'response_wait_backed' end when api > 0 then case when span > 0 then 'mixed_duration_and_gap' else 'duration_backed' end else 'gap_heuristic' end as timing_quality from s""")
def scl_11(spark, d):
    wait = F.coalesce(F.sum(F.when(F.col("human_authored"), F.col("wait_ms"))), F.lit(0))
    s = messages(spark, d).groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n"), wait.alias("wait"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("api"), (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("span"), (F.countDistinct("ts") / F.count(F.lit(1))).alias("uniq"))
    return s.select("dialogue_id", timing_quality(F.col("n"), F.col("span"), F.col("wait"), F.lit(0), F.col("api"), F.col("span"), F.col("uniq")).alias("timing_quality"))


def timing_quality(n, gap, wait, turn, api, span, unique_share, estimate=None, has_times=None):
    """The label of a session's timing, by precedence, then the overrides for suspect timestamps."""
    none = F.lit(None).cast("string") if estimate is None else estimate
    label = F.when(wait > 0, F.when(gap > 0, "mixed_response_wait_and_gap").otherwise("response_wait_backed")).when(turn > 0, "exact_turn_duration").when(none.isNotNull(), none)
    label = label.when(api > 0, F.when(gap > 0, "mixed_duration_and_gap").otherwise("duration_backed")).otherwise("gap_heuristic")
    missing = F.lit(False) if has_times is None else ~has_times & (api == 0) & none.isNull()
    quarter = 15 * 60 * 1000
    return (
        F.when(missing, "missing_timing")
        .when((n >= 500) & (api == 0) & (span <= quarter) & (unique_share < 0.25), "timestamp_replay_suspect")
        .when((n >= 1000) & (api == 0) & (gap <= quarter), "low_active_many_messages")
        .otherwise(label)
    )


@query("flagship_usage_report", f"""with {MSG}, g as ({acc_sql('harness')}), p as (select harness, {_PCT} from msg group by harness), {_TURNS.format(keys='harness')}, w as (select harness, count(*) as wait_turns, cast(sum(wait_ms) as bigint) as wait_ms from t group by harness),
 b as (select harness, model_key, count(*) as n from msg where model_key is not null group by all), top as (select harness, model_key as top_model from (select *, row_number() over (partition by harness order by n desc, model_key) as r from b) where r = 1)
 select g.*, {_RATES}, p.* exclude (harness), w.* exclude (harness), top.top_model from g join p using (harness) join w using (harness) join top using (harness)""")
def flagship(spark, d):
    """Grouped usage with validity splits, exact percentiles, distinct dialogues, turn waits and the top model."""
    # Four passes need these columns; the lines meet their orders once, for all of them.
    m = settled(messages(spark, d).drop("turn_id", "sequence", "visible", "tool_name", "workspace", "ts"), "usage")
    g = U.finalize(U.accumulate(m, "harness"))
    p = m.groupBy("harness").agg(*(v.alias(k) for k, v in U.percentiles().items()))
    w = U.wait_sums(m, "harness").drop("wait_p50", "wait_p90")
    top = S.first_by(m.filter("model_key is not null").groupBy("harness", "model_key").count(), ["harness"], [F.desc("count"), F.asc("model_key")]).select("harness", F.col("model_key").alias("top_model"))
    return g.join(p, "harness").join(w, "harness").join(top, "harness")
