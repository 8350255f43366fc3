"""Maintenance of records, values read from texts, export selections, projections and vector search under filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import documents as D
from parley.functions import texts as T
from parley.operators import export as X
from parley.operators import lineage as L
from parley.operators import maintenance as M
from parley.operators import projections as P
from parley.operators import reconcile as C
from parley.operators import retrieval as R
from parley.operators import segments as G
from parley.plans.search_queries import _BM, _COS, _bm25
from parley.plans.tables import MSG, events, messages, query, table

# ------------------------------------------------------------------ values


def _events(spark, d, expression: str, name: str = "x"):
    """Event ids with a text made of each event, by an expression of both dialects."""
    return table(spark, d, "events").select("event_id", F.expr(expression.replace("::varchar", "::string")).alias(name))


_SKILL = """case event_id % 4 when 0 then concat('{"skill":"', event_type, '"}') when 1 then concat('"{\\\\"skill\\\\":\\\\"', event_type, '\\\\"}"') when 2 then concat('{"path":"/home/u/', event_type, '/SKILL.md"}') else '{"path":"/home/u/README.md"}' end"""


@query("scl_13_skill_names", "select event_id, case when event_id % 4 < 3 then event_type end as skill from events")
def scl_13(spark, d):
    """Skills of tool calls whose arguments are plain JSON, JSON in a string, a path to a skill's file, or neither."""
    return _events(spark, d, _SKILL).select("event_id", D.skill_name(F.col("x")).alias("skill"))


@query("scl_16_canonical_json", """select event_id, concat('{"a":{"c":"', event_type, '","d":[2,1]},"b":', event_id, '}') as json from events""")
def scl_16(spark, d):
    raw = """concat('{ "b": ', event_id, ', "a": {"d": [2, 1], "c": "', event_type, '"}}')"""
    return _events(spark, d, raw).select("event_id", D.canonical_json(F.col("x")).alias("json"))


@query("scl_18_timestamps", "select event_id, case event_id % 5 when 0 then epoch_us(ts) // 1000 // 1000 * 1000 when 1 then epoch_us(ts) // 1000 when 2 then epoch_us(ts) // 1000 // 1000 * 1000 end as ms from events")
def scl_18(spark, d):
    """Epoch seconds, epoch milliseconds and ISO text; years outside 2000 to 2100 and other texts are NULL."""
    ts = F.col("ts").cast("timestamp")
    ms = F.unix_millis(ts)
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    k = F.col("event_id") % 5
    x = F.when(k == 0, F.floor(ms / 1000).cast("string")).when(k == 1, ms.cast("string")).when(k == 2, iso).when(k == 3, "1890-01-01T00:00:00Z").otherwise("soon")
    return table(spark, d, "events").select("event_id", F.unix_millis(T.parse_timestamp(x)).alias("ms"))


_WORKED = """case event_id % 4 when 0 then concat('Worked for ', event_id % 5 + 1, 'h ', event_id % 50 + 1, 'm ', event_id % 59, 's.') when 1 then concat('I worked for ', event_id % 7 + 1, '.5 hours') when 2 then concat('worked for ', event_id % 90 + 1, ' seconds') else concat('slept for ', event_id, 's') end"""


@query("scl_19_worked_for", "select event_id, cast(case event_id % 4 when 0 then ((event_id % 5 + 1) * 3600 + (event_id % 50 + 1) * 60 + event_id % 59) * 1000 when 1 then (event_id % 7 + 1) * 3600000 + 1800000 when 2 then (event_id % 90 + 1) * 1000 end as bigint) as ms from events")
def scl_19(spark, d):
    return _events(spark, d, _WORKED).select("event_id", T.worked_for_ms(F.col("x")).alias("ms"))


_KEY = "export key"
_PAD = [_KEY.encode().ljust(64, b"\0").translate(bytes(i ^ x for i in range(256))) for x in (0x36, 0x5C)]
_BLOB = ["".join(f"\\x{b:02X}" for b in pad) for pad in _PAD]


@query("scl_22_hmac_alias", f"select page_id, 'p_' || substr(sha256('{_BLOB[1]}'::blob || from_hex(sha256('{_BLOB[0]}'::blob || encode(url)))), 1, 16) as alias from pages")
def scl_22(spark, d):
    return table(spark, d, "pages").select("page_id", D.alias(F.col("url"), _KEY, "p").alias("alias"))


@query("scl_27_json_pointer", "select event_id, cast(event_id as varchar) as x, event_type as y from events")
def scl_27(spark, d):
    raw = """concat('{"a/b":[0,', event_id, '],"c~d":{"e":"', event_type, '"}}')"""
    return _events(spark, d, raw, "raw").select("event_id", D.json_pointer(F.col("raw"), "/a~1b/1").alias("x"), D.json_pointer(F.col("raw"), "/c~0d/e").alias("y"))


@query("scl_29_host_class", "select event_id, case event_id % 5 when 0 then 'macos' when 1 then 'linux' when 2 then 'windows' when 3 then 'linux-root' else 'unknown' end as system, case event_id % 5 when 3 then 'root' when 4 then null else 'u' || user_id end as owner from events")
def scl_29(spark, d):
    k, user = F.col("event_id") % 5, F.concat(F.lit("u"), F.col("user_id"))
    path = F.when(k == 0, F.concat(F.lit("/Users/"), user, F.lit("/x"))).when(k == 1, F.concat(F.lit("/home/"), user, F.lit("/x"))).when(k == 2, F.concat(F.lit("C:\\Users\\"), user, F.lit("\\x"))).when(k == 3, F.lit("/root/x")).otherwise("/srv/x")
    h = D.host_class(path)
    return table(spark, d, "events").select("event_id", h["system"].alias("system"), h["user"].alias("owner"))


# ------------------------------------------------------------------ dimensions, errors, reparse, privacy


@query("dim_02_workspaces", """with known as (select s_suppkey as id, 'h' || s_nationkey as host, '/w/' || s_suppkey % 40 as path, case when s_suppkey % 2 = 0 then 'r' || s_suppkey % 50 end as repository from supplier),
 r as (select repository, min(id) as by_repo from known where repository is not null group by 1), p as (select host, path, min(id) as by_path from known group by all),
 s as (select c_custkey as id, 'h' || c_nationkey as host, '/w/' || c_custkey % 40 as path, case when c_custkey % 3 = 0 then 'r' || c_custkey % 70 end as repository from customer)
 select s.id, coalesce(by_repo, by_path) as workspace_id, case when by_repo <> by_path then 'relinked' when by_repo is not null then 'repository' when by_path is not null then 'path' else 'new' end as found_by from s left join r using (repository) left join p using (host, path)""")
def dim_02(spark, d):
    known = table(spark, d, "supplier").selectExpr("s_suppkey as workspace_id", "concat('h', s_nationkey) as host", "concat('/w/', s_suppkey % 40) as path", "case when s_suppkey % 2 = 0 then concat('r', s_suppkey % 50) end as repository")
    seen = table(spark, d, "customer").selectExpr("c_custkey as id", "concat('h', c_nationkey) as host", "concat('/w/', c_custkey % 40) as path", "case when c_custkey % 3 = 0 then concat('r', c_custkey % 70) end as repository")
    return M.resolve_workspaces(seen, known)


_ERR = "case when o_custkey % 7 = 0 then null else o_orderpriority end as stage, o_orderstatus as kind, epoch_us(o_orderdate) as at_us from orders"


@query("err_01_quarantine", f"select stage, kind, min(at_us) as first_failed, max(at_us) as last_failed, count(*) as n from (select {_ERR}) group by stage, kind")
def err_01(spark, d):
    """Known and new quarantine rows, one for each identity; NULL is a value of it."""
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, d, "orders").select("o_orderkey", F.expr("case when o_custkey % 7 = 0 then null else o_orderpriority end").alias("stage"), F.col("o_orderstatus").alias("kind"), at.alias("first_failed"), at.alias("last_failed"), F.lit(1).cast("bigint").alias("n"))
    known = M.merge_errors(rows.filter("o_orderkey % 2 = 0").drop("o_orderkey"), rows.filter("false").drop("o_orderkey"), ["stage", "kind"])
    return M.merge_errors(known, rows.filter("o_orderkey % 2 <> 0").drop("o_orderkey"), ["stage", "kind"])


@query("err_02_resolved", "select o_orderkey as error_id, o_orderstatus = 'F' or (o_orderkey % 5 < 3 and c_mktsegment = 'BUILDING') as resolved from orders join customer on o_custkey = c_custkey")
def err_02(spark, d):
    errors = table(spark, d, "orders").select(F.col("o_orderkey").alias("error_id"), F.col("o_custkey").alias("revision_id"), (F.col("o_orderkey") % 5).alias("run"), (F.col("o_orderstatus") == "F").alias("resolved"))
    revisions = table(spark, d, "customer").select(F.col("c_custkey").alias("revision_id"), F.when(F.col("c_mktsegment") == "BUILDING", "parsed").otherwise("partial").alias("status"))
    return M.resolve_errors(errors, revisions, 3).select("error_id", "resolved")


@query("rep_01_reparse", "select doc_id, 'parse' as what from labels where doc_id in (select doc_id * 3 from documents) union all select doc_id * 3, 'missing' from documents where doc_id * 3 not in (select doc_id from labels)")
def rep_01(spark, d):
    """Current revisions that are asked for, and what is asked for without having one."""
    found, missing = M.select_reparse(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select((F.col("doc_id") * 3).alias("doc_id")), "doc_id")
    return found.select("doc_id", F.lit("parse").alias("what")).unionByName(missing.select("doc_id", F.lit("missing").alias("what")))


@query("orp_01_orphans", "with p as (select sha256(text) as sha256, count(distinct source) as n, min(source) as s from documents where doc_id % 3 <> 0 group by 1), o as (select distinct sha256(text) as sha256 from documents) select sha256, case when n = 1 then 'repairable' else 'manual' end as action, case when n = 1 then s end as location from o left join p using (sha256)")
def orp_01(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("source").alias("location"))
    return M.attribute_orphans(t.select("sha256").distinct(), t.filter("doc_id % 3 <> 0"))


_JOB = "case doc_id % 5 when 0 then 'pending' when 1 then 'leased' when 2 then 'completed' when 3 then 'cancelled' end"


@query("prv_01_privacy_plan", f"""with x as (select d.doc_id, case when l.toxic = 1 then 'toxic' end as reason, {_JOB.replace('doc_id', 'd.doc_id')} as status, v.vec_id is not null as has from documents d left join labels l using (doc_id) left join embeddings v on v.vec_id = d.doc_id)
 select doc_id, reason, case when reason is not null and has then 'drop_vector' when reason is not null and status in ('pending', 'leased') then 'cancel_job' when reason is null and (status = 'cancelled' or (status is null and not has)) then 'enqueue' else 'keep' end as action from x""")
def prv_01(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("reason"))
    jobs = table(spark, d, "documents").select("doc_id", F.expr(_JOB).alias("status")).filter("status is not null")
    return M.privacy_plan(docs, jobs, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("mig_03_vector_audit", "with v as (select vec_id as doc_id, case when vec_id % 50 = 0 then 63 else 64 end as n from embeddings), j as (select doc_id from documents where doc_id % 3 <> 0) select * from (select 'wrong_dimension' as problem, count(*) as n from v where n <> 64 union all select 'vector_without_completed_job', count(*) from v where doc_id not in (from j) union all select 'completed_job_without_vector', count(*) from j where doc_id not in (select doc_id from v)) where n > 0")
def mig_03(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    return M.vector_audit(v, table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("completed").alias("status")), 64)


@query("mig_04_exclusion", "with x as (select doc_id, sha256(text) as h, lang, source from documents) select doc_id from x where source = 'src0' and exists (select 1 from x y where y.source <> 'src0' and y.h = x.h and y.lang = x.lang)")
def mig_04(spark, d):
    """Quarantined rows whose content stands elsewhere too."""
    x = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang", "source")
    return M.exclusion_eligible(x.filter("source = 'src0'"), x.filter("source <> 'src0'"), ["h", "lang"]).select("doc_id")


@query("mig_05_latest_attempt", "select o_custkey as lineage_key, o_orderkey as id, o_orderkey % 7 as attempt from orders qualify row_number() over (partition by o_custkey order by o_orderkey % 7 desc, o_orderkey desc) = 1")
def mig_05(spark, d):
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("lineage_key"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("attempt"))
    return M.latest_attempts(q).select("lineage_key", "id", "attempt")


# ------------------------------------------------------------------ state

_OLD = "case when page_id % 3 = 0 then sha256(html) end as osha, strlen(html) as osize, page_id as omtime, case when page_id % 2 = 0 then substr(url, 1, 8) end as ohead"
_NEW = "case when page_id % 3 <> 1 then sha256(html || case when page_id % 6 = 0 then 'x' else '' end) end as nsha, strlen(html) + case when page_id % 7 = 0 then 1 else 0 end as nsize, page_id + page_id % 11 // 10 as nmtime, case when page_id % 4 = 0 then substr(url, 1, 9) end as nhead"


@query("str_03_fingerprints", f"select page_id, case when osha is not null and nsha is not null then osha <> nsha when osize <> nsize then true when omtime <> nmtime then true when ohead is not null and nhead is not null then ohead <> nhead else false end as differs from (select page_id, {_OLD}, {_NEW} from pages)")
def str_03(spark, d):
    p, k = table(spark, d, "pages"), F.col("page_id")
    size = F.octet_length("html")
    old = F.struct(F.when(k % 3 == 0, F.sha2("html", 256)).alias("sha256"), size.alias("size_bytes"), k.alias("mtime_ms"), F.when(k % 2 == 0, F.substring("url", 1, 8)).alias("head_hash"))
    new = F.struct(
        F.when(k % 3 != 1, F.sha2(F.concat("html", F.when(k % 6 == 0, "x").otherwise("")), 256)).alias("sha256"), (size + F.when(k % 7 == 0, 1).otherwise(0)).alias("size_bytes"),
        (k + F.floor(k % 11 / 10)).alias("mtime_ms"), F.when(k % 4 == 0, F.substring("url", 1, 9)).alias("head_hash"),
    )
    return p.select("page_id", old.alias("old"), new.alias("new")).select("page_id", C.fingerprint_differs("old", "new").alias("differs"))


_NOW, _LEASED = 1_000_000, 700_000


@query("str_04_lease", f"""with j as (select o_orderkey as id, case o_orderkey % 4 when 0 then 'pending' when 1 then 'leased' when 2 then 'completed' else 'pending' end as status, o_custkey as created_at, o_orderkey % 10 as attempts, case when o_orderkey % 3 = 0 then {_NOW} + o_orderkey % 2 end as not_before, {_LEASED} + o_orderkey % 5 - 2 as locked_at from orders)
 select id, attempts + 1 as attempts, {_NOW} as locked_at from j where ((status = 'pending' and coalesce(not_before, 0) <= {_NOW}) or (status = 'leased' and locked_at + 300000 <= {_NOW})) and attempts < 8 order by created_at, id limit 100""")
def str_04(spark, d):
    """The next 100 due jobs: the limit is what a worker takes."""
    k = F.col("o_orderkey")
    jobs = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 4 == 1, "leased").when(k % 4 == 2, "completed").otherwise("pending").alias("status"), F.col("o_custkey").alias("created_at"), (k % 10).alias("attempts"),
        F.when(k % 3 == 0, _NOW + k % 2).alias("not_before"), (_LEASED + k % 5 - 2).alias("locked_at"),
    )
    return C.lease(jobs, _NOW, 100).select("id", "attempts", "locked_at")


@query("rpt_05_session_time", f"""with {MSG}, s as (select dialogue_id, harness, max(model_key) as model, sum(coalesce(duration_ms, 0)) as active_ms from msg group by dialogue_id, harness), g as (select distinct harness, model_key as model from msg where model_key is not null)
 select g.harness, g.model, cast(coalesce(sum(s.active_ms), 0) as bigint) as active_ms, count(s.dialogue_id) as sessions from g left join s on s.harness = g.harness and s.model = g.model group by all""")
def rpt_05(spark, d):
    m = messages(spark, d)
    s = m.groupBy("dialogue_id", "harness").agg(F.max("model_key").alias("model"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("active_ms"))
    return M.mapped_session_time(s, m.filter("model_key is not null").select(F.col("model_key").alias("model"), "harness").distinct()).select("harness", "model", "active_ms", "sessions")


# ------------------------------------------------------------------ segments


@query("seg_01_coverage", "select doc_id, md5(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', '', 'g')) as content, true as within from documents")
def seg_01(spark, d):
    """Every document's segments hold all of its text in order, and none passes the limit."""
    s = G.segment_documents(table(spark, d, "documents").select("doc_id", "text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("segment_no", "content"))), lambda x: x["content"])
    g = s.groupBy("doc_id").agg(ordered.alias("parts"), (F.max("token_count") <= G.MOST).alias("within"))
    return g.select("doc_id", F.md5(F.regexp_replace(F.array_join("parts", ""), r"[ \t\n\r\f\x0B]+", "")).alias("content"), "within")


# ------------------------------------------------------------------ export selections

_REV = "select c_custkey as revision, c_custkey % 90 as dialogue, case when c_custkey % 5 = 0 then null else c_mktsegment end as harness, 'h' || c_nationkey as host, case when c_custkey % 11 = 0 then 'building' else 'ready' end as status, c_custkey % 2 = 0 as is_current from customer"


@query("flt_09_manifest", f"select revision, harness, host from ({_REV}) where status = 'ready' and is_current and harness in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') and (host is null or host not in ('h3', 'h7')) and (harness is null or harness not in ('MACHINERY'))")
def flt_09(spark, d):
    revisions = table(spark, d, "customer").selectExpr(
        "c_custkey as revision", "c_custkey % 90 as dialogue", "case when c_custkey % 5 = 0 then null else c_mktsegment end as harness", "concat('h', c_nationkey) as host",
        "case when c_custkey % 11 = 0 then 'building' else 'ready' end as status", "c_custkey % 2 = 0 as is_current",
    )
    return X.manifest(revisions, {"harness": ["BUILDING", "MACHINERY", "AUTOMOBILE"], "platform": []}, {"host": ["h3", "h7"], "harness": ["MACHINERY"]}).select("revision", "harness", "host")


@query("flt_11_field_whitelist", "select event_id as id, cast(null as varchar) as title, cast(null as bigint) as timestamp, event_type as model, cast(null as double) as usage from events")
def flt_11(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("ms").alias("timestamp"), F.col("event_type").alias("model"), F.col("value").alias("usage"))
    return X.whitelist(rows, "messages", ["messages.model", "hosts.label"])


_CATEGORY = "case o_orderkey % 11 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(X.CATEGORIES)) + " end"
_IN = {p: ", ".join(f"'{c}'" for c in cs) for p, cs in X.PRESETS.items()}


@query("flt_13_presets", " union all ".join(f"select '{p}' as preset, category, count(*) as n from (select {_CATEGORY} as category from orders) where category in ({cs}) group by all" for p, cs in _IN.items()))
def flt_13(spark, d):
    items, out = table(spark, d, "orders").select(F.expr(_CATEGORY).alias("category")), None
    for p in X.PRESETS:
        part = X.preset_items(items, p).groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("preset"), "category", "n")
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ vectors


@query("top_02_filtered_topk", """with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), c as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) as score from v, v q where q.vec_id % 100 = 0 and v.label % 2 = 0)
 select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from c qualify rank <= 50""")
def top_02(spark, d):
    """The 50 nearest under a filter, which holds before the top is taken; queries are the rows whose id is divisible by 100."""
    v = table(spark, d, "embeddings")
    return R.cosine_search(v.filter("label % 2 = 0"), v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 50)


_ITEM_COS = _COS.replace("q.vec_id % 100 = 0", "q.vec_id in (select item_id from benchmark)")


@query("ret_10_text_and_vectors", f"""with {_BM}, r as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from h qualify rank <= 50), {_ITEM_COS},
 f as (select query_id, doc_id, rank from r union all select query_id, doc_id, rank from cr where rank <= 50), z as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score from f group by all)
 select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from z qualify rank <= 20""")
def ret_10(spark, d):
    """Hybrid retrieval: the text list of an item and the vector list of the vector of its id, fused by rank."""
    v = table(spark, d, "embeddings")
    queries = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    fused = R.reciprocal_rank_fusion(R.top_k(_bm25(spark, d, False, 50), 50, ["query_id"]), R.cosine_search(v, queries, 50))
    return R.top_k(fused, 20, ["query_id"])


@query("ret_09_mock_vectors", "with h as (select item_id, sha256(encode(text) || '\\x00\\x00\\x00\\x00'::blob) as a, sha256(encode(text) || '\\x00\\x00\\x00\\x01'::blob) as b from benchmark) select item_id, round(('0x' || substr(a, 1, 8))::bigint / 2147483648.0::double - 1, 9) as x1, round(('0x' || substr(a, 57, 8))::bigint / 2147483648.0::double - 1, 9) as x8, round(('0x' || substr(b, 1, 8))::bigint / 2147483648.0::double - 1, 9) as x9 from h")
def ret_09(spark, d):
    v = table(spark, d, "benchmark").select("item_id", P.mock_vector(F.col("text"), 12).alias("v"))
    return v.select("item_id", *(F.round(F.col("v")[i - 1], 9).alias(f"x{i}") for i in (1, 8, 9)))


_MATRIX = np.random.default_rng(7).normal(size=(64, 4)) / np.sqrt(4)  # the matrix of seed 7
_COLUMNS = ", ".join(f"round(list_dot_product(list_transform(embedding, lambda x: x::double), [{', '.join(repr(float(x)) for x in _MATRIX[:, j])}]::double[]), 5) as p{j}" for j in range(4))


@query("clu_02_random_projection", f"select vec_id, {_COLUMNS} from embeddings")
def clu_02(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", P.random_projection(F.col("embedding"), 64, 4).alias("p"))
    return v.select("vec_id", *(F.round(F.col("p")[j], 5).alias(f"p{j}") for j in range(4)))


@query("clu_03_spherical_kmeans")
def clu_03(spark, d):
    """Clusters of all vectors; a test holds them against separated groups."""
    return P.spherical_kmeans(table(spark, d, "embeddings").select("vec_id", "embedding"), 8).select("vec_id", F.col("cluster").cast("bigint").alias("cluster"))
