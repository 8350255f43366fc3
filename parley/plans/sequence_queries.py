"""Windows, gaps, turns, retention of firsts, and state machines over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import numbers as N
from parley.functions import texts as T
from parley.operators import reconcile as R
from parley.operators import sequences as S
from parley.operators.percentiles import nearest_ranks
from parley.plans.tables import EVT, events, query, table

_GAP = """g as (select user_id, ms, ms - lag(ms) over (partition by user_id order by ms) as gap from (select distinct user_id, ms from evt))"""


def _active(idle):
    return f"with {EVT}, {_GAP} select user_id, cast(coalesce(sum(gap) filter (where gap > 0 and gap <= {idle}), 0) as bigint) as active_ms from g group by user_id"


@query("win_01_active_time", _active(180_000))
def win_01(spark, d):
    return S.active_time(events(spark, d), "user_id", "ms", 180_000)


@query("win_01_active_time_hours", _active(6 * 3_600_000))
def win_01_hours(spark, d):
    return S.active_time(events(spark, d), "user_id", "ms", 6 * 3_600_000)


@query("win_02_gap_by_day", f"with {EVT}, {_GAP} select user_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') as day, cast(sum(gap) as bigint) as gap_ms from g where gap > 0 and gap <= 21600000 group by all")
def win_02(spark, d):
    t = events(spark, d).select("user_id", "ms").distinct().withColumn("gap", F.col("ms") - F.lag("ms").over(W.partitionBy("user_id").orderBy("ms")))
    return t.filter("gap > 0 and gap <= 21600000").groupBy("user_id", F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd").alias("day")).agg(F.sum("gap").alias("gap_ms"))


_TURN = "t as (select *, cast(sum(case when role = 'user' and trim(text) <> '' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as turn_no from conversations)"


def _turns(spark, d):
    c = table(spark, d, "conversations")
    return S.turns(c, "conv_id", "turn", (F.col("role") == "user") & (F.trim("text") != ""))


@query("win_03_turn_segmentation", f"with {_TURN} select conv_id, turn, turn_no from t")
def win_03(spark, d):
    return _turns(spark, d).select("conv_id", "turn", "turn_no")


@query("win_04_search_turn_windows", f"with {_TURN} select conv_id, turn_no, min(turn) as first_turn, max(turn) as last_turn, count(*) as messages, cast(sum(length(text)) as bigint) as chars from t where turn_no > 0 group by all")
def win_04(spark, d):
    return _turns(spark, d).filter("turn_no > 0").groupBy("conv_id", "turn_no").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"))


@query("win_05_last_boundary", "select conv_id, max(turn) filter (where role = 'user' and trim(text) <> '') as last_boundary from conversations group by conv_id")
def win_05(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("turn"))).alias("last_boundary"))


@query("win_06_last_answer", "select conv_id, max(turn) filter (where role = 'assistant' and text <> '') as final_turn, sha256(arg_max(text, turn) filter (where role = 'assistant' and text <> '')) as final_sha from conversations group by conv_id")
def win_06(spark, d):
    ok = (F.col("role") == "assistant") & (F.col("text") != "")
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(ok, F.col("turn"))).alias("final_turn"), F.max_by(F.col("text"), F.when(ok, F.col("turn"))).alias("t"))
    return g.select("conv_id", "final_turn", F.when(F.col("final_turn").isNotNull(), F.sha2("t", 256)).alias("final_sha"))


@query("win_07_turn_text", f"with {_TURN} select conv_id, turn_no, sha256(string_agg(text, chr(10) order by turn)) as text_sha, count(*) as n from t where role = 'assistant' group by all")
def win_07(spark, d):
    g = _turns(spark, d).filter("role = 'assistant'").groupBy("conv_id", "turn_no").agg(S.ordered_text(["conv_id"], "turn", "text").alias("t"), F.count(F.lit(1)).alias("n"))
    return g.select("conv_id", "turn_no", F.sha2("t", 256).alias("text_sha"), "n")


@query("win_08_collapse_repeats", "with o as (select *, lag(event_type) over w as before, row_number() over w as n from events window w as (partition by user_id order by ts, event_id)) select user_id, event_id, event_type from o where n = 1 or before is distinct from event_type")
def win_08(spark, d):
    return S.collapse_repeats(events(spark, d).select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "event_type").drop("ts")


@query("win_09_longest_runs", """with o as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events),
 p as (select a.user_id, a.i as i, b.i as j from o a join o b on a.user_id = b.user_id - 1 and a.event_type = b.event_type),
 d as (select *, j - i as d, i - row_number() over (partition by user_id, j - i order by i) as island from p),
 r as (select user_id, d, island, count(*) as run, min(i) as start_i, min(j) as start_j from d group by all having count(*) >= 3),
 f as (select *, row_number() over (partition by user_id order by run desc, d, start_i) as r from r) select user_id, run, start_i, start_j from f where r = 1""")
def win_09(spark, d):
    """Every user's events against the next user's."""
    o = events(spark, d).withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")).select("user_id", "event_type", "i")
    b = o.select((F.col("user_id") - 1).alias("user_id"), "event_type", F.col("i").alias("j"))
    return S.longest_runs(o.join(b, ["user_id", "event_type"]).select("user_id", "i", "j"), "user_id", "i", "j")


@query("win_12_per_partition_cap", "select source, doc_id, rank from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents) where rank <= 3")
def win_12(spark, d):
    return S.first_by(table(spark, d, "documents"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3, "rank").select("source", "doc_id", "rank")


@query("win_13_first_per_key", "select text_md5, doc_id from (select md5(text) as text_md5, doc_id, row_number() over (partition by md5(text) order by doc_id) as r from documents) where r = 1")
def win_13(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"))


@query("win_14_latest_revision", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def win_14(spark, d):
    return S.first_by(events(spark, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("win_15_max_concurrent", f"""with {EVT}, e as (select event_type, ms as t0, 1 as d from evt union all select event_type, ms + cast(floor(value * 60000) as bigint), -1 from evt),
 o as (select event_type, sum(d) over (partition by event_type order by t0, d rows between unbounded preceding and current row) as n from e) select event_type, cast(max(n) as bigint) as max_open from o group by event_type""")
def win_15(spark, d):
    e = events(spark, d).withColumn("end", F.col("ms") + F.floor(F.col("value") * 60000))
    return S.max_concurrent(e, "event_type", "ms", "end")


@query("win_16_counter_resets", f"with {EVT}, o as (select *, lag(value) over (partition by user_id order by ms, event_id) as before from evt) select user_id, count(*) as resets from o where value < 0.5::double * before group by user_id")
def win_16(spark, d):
    o = events(spark, d).withColumn("before", F.lag("value").over(W.partitionBy("user_id").orderBy("ms", "event_id")))
    return o.filter(F.col("value") < F.lit(0.5) * F.col("before")).groupBy("user_id").agg(F.count(F.lit(1)).alias("resets"))


@query("win_18_turn_wait", f"""with {EVT}, t as (select *, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ms, event_id rows between unbounded preceding and current row) as turn_no from evt)
 select user_id, cast(turn_no as bigint) as turn_no, max(ms) - min(ms) as wait_ms, count(*) as n from t where event_type <> 'click' and turn_no > 0 group by all""")
def win_18(spark, d):
    w = W.partitionBy("user_id").orderBy("ms", "event_id").rowsBetween(W.unboundedPreceding, 0)
    t = events(spark, d).withColumn("turn_no", F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(w))
    return t.filter("event_type <> 'click' and turn_no > 0").groupBy("user_id", "turn_no").agg((F.max("ms") - F.min("ms")).alias("wait_ms"), F.count(F.lit(1)).alias("n"))


@query("flt_07_turn_scope", f"""with {_TURN}, m as (select conv_id, turn, role = 'assistant' as hit, bool_or(role = 'assistant') over (partition by conv_id, turn_no) as in_turn, bool_or(role = 'system') over (partition by conv_id) as in_dialogue from t)
 select conv_id, turn, hit, in_turn, in_dialogue from m""")
def flt_07(spark, d):
    t = _turns(spark, d)
    hit = F.col("role") == "assistant"
    return t.select("conv_id", "turn", hit.alias("hit"), F.bool_or(hit).over(W.partitionBy("conv_id", "turn_no")).alias("in_turn"), F.bool_or(F.col("role") == "system").over(W.partitionBy("conv_id")).alias("in_dialogue"))


@query("flt_08_half_open_range", "select event_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'")
def flt_08(spark, d):
    return table(spark, d, "events").filter("ts >= timestamp_ntz '2024-01-10 00:00:00' and ts < timestamp_ntz '2024-01-20 00:00:00'").select("event_id")


@query("scl_05_local_day", "select strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%Y-%m-%d') as day, count(*) as n from events group by day")
def scl_05(spark, d):
    return events(spark, d).groupBy(T.day_key(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("scl_06_inclusive_days", "select user_id, cast(date_diff('day', cast(min(ts) as date), cast(max(ts) as date)) + 1 as bigint) as days from events group by user_id")
def scl_06(spark, d):
    return events(spark, d).groupBy("user_id").agg(T.inclusive_days(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).alias("days"))


@query("scl_10_effective_active", "select event_id, case when value > 50 then value else greatest(value / 2, event_id % 40) end as active_ms from events")
def scl_10(spark, d):
    wait = F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)
    return table(spark, d, "events").select("event_id", N.effective_active_ms(F.col("value") / 2, (F.col("event_id") % 40).cast("double"), wait).alias("active_ms"))


@query("scl_21_backoff", f"with {EVT} select k, cast(least(10000 * pow(2, k - 1), 3600000) as bigint) as wait_ms, count(*) as n from evt group by all")
def scl_21(spark, d):
    return events(spark, d).groupBy("k", N.backoff_ms(F.col("k")).alias("wait_ms")).agg(F.count(F.lit(1)).alias("n"))


@query("scl_28_calendar_grid", "with r as (select date_trunc('week', min(ts))::date as a, max(ts)::date as b from events), days as (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from r) select strftime(day, '%Y-%m-%d') as day, cast(isodow(day) as bigint) as weekday, count(event_id) as n from days left join events on ts::date = day group by all")
def scl_28(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id")
    days = e.agg(F.trunc(F.min("day"), "week").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(e, "day", "left").groupBy("day").agg(F.count("event_id").alias("n")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), (F.weekday("day") + 1).cast("bigint").alias("weekday"), "n")


@query("agg_18_count_by_status", "select event_type, count(*) as n from events group by event_type")
def agg_18(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_26_latency_summary", "select event_type, round(avg(value), 6) as mean, percentile_disc(0.5) within group (order by value) as p50, percentile_disc(0.95) within group (order by value) as p95, max(value) as most from events group by event_type")
def agg_26(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    return g.join(nearest_ranks(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "event_type", "left")


@query("top_03_top_positive", "select user_id, cast(sum(value) as bigint) as v from events group by user_id having sum(value) > 0 order by v desc, user_id limit 1")
def top_03(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("s")).filter("s > 0").select("user_id", F.expr("cast(bround(s) as bigint)").alias("v")).orderBy(F.desc("v"), "user_id").limit(1)


@query("str_02_presence_state", f"""with {EVT}, s as (select event_type, user_id, max(ms) as seen from evt group by all), t as (select max(ms) as now from evt)
 select event_type, user_id, case when (now - seen) // 86400000 = 0 then 'active' when (now - seen) // 86400000 < 3 then 'missing' else 'deleted' end as presence from s, t""")
def str_02(spark, d):
    e = events(spark, d)
    now = e.agg(F.max("ms")).first()[0]
    s = e.groupBy("event_type", "user_id").agg(F.max("ms").alias("seen"))
    return s.select("event_type", "user_id", R.presence(F.lit("active"), F.floor((F.lit(now) - F.col("seen")) / 86_400_000), 3).alias("presence"))


@query("str_06_proportional_split", f"""with {EVT}, g as (select user_id, event_id, k, sum(k) over (partition by user_id) as total, lead(event_id) over (partition by user_id order by event_id) is null as is_last from evt where k is not null),
 s as (select *, cast(floor(1000 * k / total) as bigint) as part from g where total > 0) select user_id, event_id, case when is_last then 1000 - (sum(part) over (partition by user_id) - part) else part end::bigint as part from s""")
def str_06(spark, d):
    e = events(spark, d).filter("k is not null").select("user_id", "event_id", "k")
    return R.distribute(e, "user_id", "event_id", "k", 1000).select("user_id", "event_id", "part")


@query("str_07_staleness", f"with {EVT}, o as (select *, lag(event_type) over w as t0, lag(k) over w as k0 from evt window w as (partition by user_id order by ms, event_id)) select user_id, event_id, (t0 is distinct from event_type or k0 is distinct from k) as stale from o")
def str_07(spark, d):
    w = W.partitionBy("user_id").orderBy("ms", "event_id")
    o = events(spark, d).withColumns({"t0": F.lag("event_type").over(w), "k0": F.lag("k").over(w)})
    return o.select("user_id", "event_id", R.stale([("t0", "event_type"), ("k0", "k")]).alias("stale"))


@query("str_08_last_complete_run", f"with {EVT}, r as (select user_id, strftime(ts, '%Y-%m-%d') as run, max(ms) as done, bool_or(event_type = 'error') as bad from evt group by all) select user_id, arg_max(run, done) as run from r where not bad group by user_id")
def str_08(spark, d):
    r = events(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.max("ms").alias("done"), F.bool_or(F.col("event_type") == "error").alias("bad"))
    return r.filter(~F.col("bad")).groupBy("user_id").agg(F.max_by("run", "done").alias("run"))


@query("str_05_token_batches", """with recursive i as (select source as key, doc_id, cast(ceil(length(text) / 3.5) as bigint) as tokens, row_number() over (partition by source order by doc_id) as r from documents),
 w as (select key, doc_id, tokens, r, 0::bigint as batch, 1::bigint as n, tokens as total from i where r = 1
 union all select i.key, i.doc_id, i.tokens, i.r, case when w.n >= 64 or w.total + i.tokens > 300000 then w.batch + 1 else w.batch end, case when w.n >= 64 or w.total + i.tokens > 300000 then 1 else w.n + 1 end,
 case when w.n >= 64 or w.total + i.tokens > 300000 then i.tokens else w.total + i.tokens end from w join i on i.key is not distinct from w.key and i.r = w.r + 1)
 select key, doc_id, tokens, batch from w""")
def str_05(spark, d):
    """Order-preserving batches of at most 64 items and 300 000 units a user; tests compare it with a loop."""
    items = table(spark, d, "documents").select(F.col("source").alias("key"), "doc_id", F.ceil(F.length("text") / 3.5).cast("bigint").alias("tokens"))
    return R.token_batches(items, "key", "doc_id", "tokens")


@query("str_09_session_windows", """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
 s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as n from o) select user_id, epoch_us(min(ts)) // 1000 as start_ms, count(*) as n from s group by user_id, s.n""")
def str_09(spark, d):
    """An extension: gaps of six hours part sessions."""
    g = events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_millis("w.start").alias("start_ms"), "n")
