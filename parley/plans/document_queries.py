"""Search documents, segments, replays, snippets and JSON figures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import documents as D
from parley.operators import extractors as E
from parley.operators import lineage as L
from parley.operators import maintenance as M
from parley.operators import segments as G
from parley.operators import validation as V
from parley.plans.tables import events, query, table

_TURN = "t as (select *, sum(case when role = 'user' and trim(text) <> '' then 1 else 0 end) over (partition by conv_id order by turn) as turn_no from conversations)"


@query("seg_06_search_documents", f"""with {_TURN} select cast(conv_id as varchar) as dialogue_id, cast(turn_no as bigint) as turn_no, 'user_prompt' as document_type, md5(text) as content_md5 from t where turn_no > 0 and role = 'user' and trim(text) <> ''
 union all select cast(conv_id as varchar), cast(turn_no as bigint), 'assistant_final', md5(string_agg(text, chr(10) order by turn)) from t where turn_no > 0 and role = 'assistant' and trim(text) <> '' group by conv_id, turn_no""")
def seg_06(spark, d):
    c = table(spark, d, "conversations")
    m = c.select(F.lit("opencode").alias("harness"), F.col("conv_id").cast("string").alias("dialogue_id"), F.col("turn").alias("sequence"), "role", (F.col("role") == "user").alias("human_authored"), F.lit(True).alias("visible"), "text")
    return E.search_documents(m).select("dialogue_id", "turn_no", "document_type", F.md5("content").alias("content_md5"))


@query("seg_04_segments")
def seg_04(spark, d):
    """Documents in segments; tests hold the cutter against its limits."""
    return G.segment_documents(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("segment_no").cast("bigint").alias("segment_no"), "token_count", F.md5("content").alias("content_md5"))


@query("lin_01_shared_prefixes", """with o as (select user_id, event_type as key, row_number() over (partition by user_id order by ts, event_id) as i from events), p as (select a.user_id as child, a.i as i, b.i as j from o a join o b on b.user_id = a.user_id + 1 and a.key = b.key),
 d as (select *, j - i as d, i - row_number() over (partition by child, j - i order by i) as island from p), r as (select child, d, count(*) as run, min(i) as start_i, min(j) as start_j from d group by child, d, island having count(*) >= 3),
 f as (select *, row_number() over (partition by child order by run desc, d, start_i) as r from r) select child, run as replayed, start_j from f where r = 1 and start_i = 1""")
def lin_01(spark, d):
    o = events(spark, d).withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))
    children = o.select(F.col("user_id").alias("child"), (F.col("user_id") + 1).alias("parent"), "i", F.col("event_type").alias("key"))
    return L.shared_prefixes(children, o.select(F.col("user_id").alias("parent"), F.col("i").alias("j"), F.col("event_type").alias("key")))


@query("win_17_open_turns", """with e as (select user_id as session, ts, epoch_us(ts) // 1000 as ms, case event_type when 'click' then 'started' when 'purchase' then 'complete' when 'error' then 'aborted' else event_type end as kind from events),
 t as (select *, sum(case when kind = 'started' then 1 else 0 end) over (partition by session order by ms) as turn from e), g as (select session, turn, min(ms) as s, max(ms) as l, min(ms) filter (where kind in ('complete', 'aborted')) as z from t where turn > 0 group by all)
 select session, cast(turn as bigint) as turn, coalesce(z, l) - s as duration_ms, z is not null as closed from g""")
def win_17(spark, d):
    kind = F.when(F.col("event_type") == "click", "started").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "aborted").otherwise(F.col("event_type"))
    t = M.open_turns(events(spark, d).select(F.col("user_id").alias("session"), "ms", kind.alias("kind")))
    return t.select("session", "turn", "duration_ms", (F.col("outcome") != "incomplete").alias("closed"))


@query("snk_05_thread_json", "select conv_id, md5('{\"conv_id\":' || conv_id || ',\"messages\":[' || string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}', ',' order by turn) || ']}') as digest from conversations group by conv_id")
def snk_05(spark, d):
    return M.thread_json(table(spark, d, "conversations"), "conv_id", "turn", ["turn", "role"]).select("conv_id", F.md5("document").alias("digest"))


@query("scl_26_usage_from_json", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def scl_26(spark, d):
    return table(spark, d, "events").select("event_id", D.json_pointer(F.col("props"), "/k").cast("bigint").alias("k"))


@query("eval_06_must_not_match", "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text) join labels l using (doc_id) where l.quality = 0")
def eval_06(spark, d):
    """Items found in documents that are judged unfit; the items are a small stated query set."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id")
    return docs.join(F.broadcast(items), F.contains("text", "item")).select("item_id", "doc_id")
