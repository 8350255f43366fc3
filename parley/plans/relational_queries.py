"""Joins, integrity rules, dimensions, the analytical export and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import models as M
from parley.functions import numbers as N
from parley.functions import texts as T
from parley.operators import export as X
from parley.operators import impute as I
from parley.operators import reconcile as R
from parley.operators import sequences as S
from parley.operators import validation as V
from parley.operators.percentiles import nearest_ranks
from parley.plans.tables import MSG, messages, query, table


@query("join_01_star_lookup", "select c_custkey, c_name, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def join_01(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    dims = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left")
    return c.join(F.broadcast(dims), c["c_nationkey"] == dims["n_nationkey"], "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("join_02_fact_dialogue", "select o_custkey, count(*) as lines, round(sum(l_extendedprice), 2) as price from lineitem join orders on l_orderkey = o_orderkey group by o_custkey")
def join_02(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("join_03_semi_by_ids", "select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1)")
def join_03(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("join_04_missing_jobs", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def join_04(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("join_05_orphans", "select c_custkey from customer left join orders on o_custkey = c_custkey where o_orderkey is null")
def join_05(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("join_06_analysis_view", f"with {MSG} select harness, workspace, role, model_key, count(*) as n, cast(sum(content_chars) as bigint) as chars from msg group by all")
def join_06(spark, d):
    return messages(spark, d).groupBy("harness", "workspace", "role", "model_key").agg(F.count(F.lit(1)).alias("n"), F.sum("content_chars").alias("chars"))


@query("join_07_thread_catalog", "select c_custkey, count(o_orderkey) as threads, strftime(min(o_orderdate), '%Y-%m-%d') as first_day, strftime(max(o_orderdate), '%Y-%m-%d') as last_day from customer left join orders on o_custkey = c_custkey group by c_custkey")
def join_07(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    g = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey")
    return g.agg(F.count("o_orderkey").alias("threads"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))


@query("join_08_parent_lineage", """with k as (select o_orderkey as id, o_custkey * 1000 + o_orderkey % 11 as own, case when o_orderkey % 3 = 0 then o_custkey * 1000 + o_orderkey % 13 end as parent from orders), n as (select own, count(*) as n from k group by own)
 select id, case when n is null then 'outside_export' when n = 1 then 'confirmed' else 'ambiguous' end as status, coalesce(n, 0) as parents from k left join n on n.own = k.parent where k.parent is not null""")
def join_08(spark, d):
    o = table(spark, d, "orders")
    k = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 1000 + F.col("o_orderkey") % 11).alias("own"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") * 1000 + F.col("o_orderkey") % 13).alias("parent"))
    return X.parent_status(k, "id", "own", "parent")


@query("join_09_tool_pairs", """with c as (select o_orderkey as rev, l_linenumber % 4 as call, l_returnflag as f from lineitem join orders on l_orderkey = o_orderkey), n as (select rev, call, count(*) filter (where f = 'A') as calls, count(*) filter (where f = 'R') as results from c group by all)
 select rev, cast(call as bigint) as call, calls, results, case when calls = 1 and results = 1 then 'confirmed' when calls = 0 or results = 0 then 'unpaired' else 'ambiguous' end as pairing from n where calls + results > 0""")
def join_09(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rev"), (F.col("l_linenumber") % 4).cast("bigint").alias("call"), F.col("l_returnflag").alias("f"))
    return X.pair_calls(l, ["rev", "call"], F.col("f") == "A", F.col("f") == "R")


@query("join_11_renames", """with x as (select cast(doc_id as varchar) as path, md5(text) as h, source from documents), m as (select * from x where source = 'src0'), n as (select * from x where source = 'src1'), a as (select * from x where source not in ('src0', 'src1')),
 m1 as (select h, min(path) as old_path from m group by h having count(*) = 1), n1 as (select h, min(path) as new_path from n group by h having count(*) = 1) select h as sha256, old_path, new_path from m1 join n1 using (h) where h not in (select h from a)""")
def join_11(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("sha256"), "source")
    return R.renames(x.filter("source = 'src0'"), x.filter("source = 'src1'"), x.filter("source not in ('src0', 'src1')")).select("sha256", "old_path", "new_path")


_OWN = "select 'line_order' as rule, count(*) as n from lineitem left join orders on l_orderkey = o_orderkey where o_orderkey is null"


@query("join_14_ownership_audit", f"""{_OWN} union all select 'order_customer', count(*) from orders left join customer on o_custkey = c_custkey where c_custkey is null
 union all select 'line_part', count(*) from lineitem left join part on l_partkey = p_partkey where p_partkey is null union all select 'line_supplier', count(*) from lineitem left join supplier on l_suppkey = s_suppkey where s_suppkey is null
 union all select 'customer_nation', count(*) from customer left join nation on c_nationkey = n_nationkey where n_nationkey is null union all select 'nation_region', count(*) from nation left join region on n_regionkey = r_regionkey where r_regionkey is null
 union all select 'label_document', count(*) from labels left join documents using (doc_id) where documents.doc_id is null""")
def join_14(spark, d):
    t = lambda n: table(spark, d, n)
    return V.foreign_keys([
        ("line_order", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), ("order_customer", t("orders"), "o_custkey", t("customer"), "c_custkey"),
        ("line_part", t("lineitem"), "l_partkey", t("part"), "p_partkey"), ("line_supplier", t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey"),
        ("customer_nation", t("customer"), "c_nationkey", t("nation"), "n_nationkey"), ("nation_region", t("nation"), "n_regionkey", t("region"), "r_regionkey"),
        ("label_document", t("labels"), "doc_id", t("documents"), "doc_id"),
    ])


@query("join_15_subquery_aggregate", "select o_custkey, count(*) as n from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') group by o_custkey having count(*) > 1")
def join_15(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("flt_04_current_revision", "select o.o_custkey, o.o_orderkey from orders o join (select o_custkey, max(o_orderkey) as cur from orders group by o_custkey) c on o.o_custkey = c.o_custkey and o.o_orderkey = c.cur")
def flt_04(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return o.join(o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")), ["o_custkey", "o_orderkey"])


@query("agg_19_duplicate_keys", "select md5(text) as h, count(*) as n from documents group by h having count(*) > 1")
def agg_19(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("agg_21_export_counts", "select role, count(*) as n, count(*) filter (where text <> '') as visible, count(distinct conv_id) as dialogues from conversations group by role")
def agg_21(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") != "").alias("visible"), F.countDistinct("conv_id").alias("dialogues"))


@query("agg_22_payload_coverage", "select source, count(*) as n, cast(sum(case when n_chars > 1000 then 1 else 0 end) as bigint) as long_docs, count(distinct case when n_chars > 1000 then lang end) as long_langs from documents group by source")
def agg_22(spark, d):
    long = F.col("n_chars") > 1000
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(long).alias("long_docs"), F.countDistinct(F.when(long, F.col("lang"))).alias("long_langs"))


@query("agg_23_duplicate_groups", "select md5(text) as h, string_agg(cast(doc_id as varchar), ',' order by doc_id) as ids from documents group by h having count(*) > 1")
def agg_23(spark, d):
    g = table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.sort_array(F.collect_list("doc_id")).alias("v")).filter(F.size("v") > 1)
    return g.select("h", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("ids"))


@query("agg_32_sources_per_item", "select l_partkey as item, count(distinct l_orderkey) as sources from lineitem group by l_partkey")
def agg_32(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.countDistinct("l_orderkey").alias("sources"))


@query("agg_33_reconciliation", "select l_returnflag as tab, count(*) as total, count(*) filter (where l_linenumber = 1) as matched, count(*) filter (where l_linenumber between 2 and 5) as inserted, count(*) filter (where l_linenumber = 6) as quarantined, count(*) filter (where l_linenumber = 7) as lost from lineitem group by l_returnflag")
def agg_33(spark, d):
    kind = F.when(F.col("l_linenumber") == 1, "matched").when(F.col("l_linenumber") < 6, "inserted").when(F.col("l_linenumber") == 6, "quarantined")
    return V.migration_reconciliation(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tab"), kind.alias("category")))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("agg_34_record_counts", " union all ".join(f"select '{t}' as tab, count(*) as n from {t}" for t in _TABLES))
def agg_34(spark, d):
    return V.record_counts({t: table(spark, d, t) for t in _TABLES})


@query("val_01_referential_rules", f"""select * from ({_OWN} union all select 'duplicate_order', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'duplicate_line', count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1)
 union all select 'wrong_length', count(*) from documents where n_chars <> length(text) union all select 'unknown_role', count(*) from conversations where role not in ('user', 'assistant', 'system', 'tool')) where n >= 0""")
def val_01(spark, d):
    t = lambda n: table(spark, d, n)
    out = V.foreign_keys([("line_order", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey")])
    out = out.unionByName(V.duplicates("duplicate_order", t("orders"), "o_orderkey")).unionByName(V.duplicates("duplicate_line", t("lineitem"), "l_orderkey", "l_linenumber"))
    out = out.unionByName(V.violations("wrong_length", t("documents"), F.col("n_chars") != F.length("text")))
    return out.unionByName(V.violations("unknown_role", t("conversations"), ~F.col("role").isin("user", "assistant", "system", "tool")))


@query("val_02_embedding_state", """select case when l.doc_id is null then 'vector_without_job' when v.vec_id is null then 'job_without_vector' else 'ok' end as state, count(*) as n from labels l full join embeddings v on l.doc_id = v.vec_id group by state""")
def val_02(spark, d):
    l, v = table(spark, d, "labels").select("doc_id"), table(spark, d, "embeddings").select("vec_id")
    state = F.when(F.col("doc_id").isNull(), "vector_without_job").when(F.col("vec_id").isNull(), "job_without_vector").otherwise("ok")
    return l.join(v, l["doc_id"] == v["vec_id"], "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("set_02_symmetric_check", "select 'job' as side, doc_id as id from labels where doc_id not in (select vec_id from embeddings) union all select 'vector', vec_id from embeddings where vec_id not in (select doc_id from labels)")
def set_02(spark, d):
    return V.symmetric_difference(table(spark, d, "labels").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "job", "vector")


@query("set_03_unreferenced", "select page_id from pages where page_id not in (select doc_id from labels)")
def set_03(spark, d):
    return table(spark, d, "pages").select("page_id").join(table(spark, d, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_anti")


@query("doc_02_primary_model_drift", f"""with {MSG}, m as (select dialogue_id, model_key, count(*) as n, max(sequence) as s from msg where model_key is not null group by all), r as (select *, row_number() over (partition by dialogue_id order by n desc, s desc, model_key) as r from m),
 f as (select dialogue_id, model_key as stored from (select *, row_number() over (partition by dialogue_id order by sequence, model_key) as k from msg where model_key is not null) where k = 1) select dialogue_id, stored, model_key as computed from r join f using (dialogue_id) where r = 1 and stored <> model_key""")
def doc_02(spark, d):
    m = messages(spark, d).filter("model_key is not null")
    top = S.first_by(m.groupBy("dialogue_id", "model_key").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("s")), ["dialogue_id"], [F.desc("n"), F.desc("s"), F.asc("model_key")])
    stored = m.groupBy("dialogue_id").agg(F.min(F.struct("sequence", "model_key"))["model_key"].alias("stored"))
    return top.join(stored, "dialogue_id").filter("stored <> model_key").select("dialogue_id", "stored", F.col("model_key").alias("computed"))


@query("dim_01_model_aliases", f"with {MSG} select split_part(model_key, '/', 1) as vendor, count(*) as n, string_agg(distinct model_key, ',' order by model_key) as aliases, strftime(min(ts), '%Y-%m-%d') as first_seen, strftime(max(ts), '%Y-%m-%d') as last_seen from msg where model_key is not null group by vendor")
def dim_01(spark, d):
    g = messages(spark, d).filter("model_key is not null").groupBy(F.substring_index("model_key", "/", 1).alias("vendor"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("model_key")), ",").alias("aliases"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_seen"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_seen"))


@query("dim_03_get_or_create", "select o_custkey, o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%d') as first_seen, strftime(max(o_orderdate), '%Y-%m-%d') as last_seen from orders group by all")
def dim_03(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_seen"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_seen"))


@query("ben_01_latency_by_mode", "select o_orderpriority as mode, percentile_disc(0.5) within group (order by o_totalprice) as p50, percentile_disc(0.95) within group (order by o_totalprice) as p95, count(*) as n from orders group by mode")
def ben_01(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), "o_totalprice")
    return o.groupBy("mode").agg(F.count(F.lit(1)).alias("n")).join(nearest_ranks(o, ["mode"], "o_totalprice", {"p50": 0.5, "p95": 0.95}), "mode").select("mode", "p50", "p95", "n")


@query("ben_02_file_search", "with s as (select unnest(['all', o_orderstatus]) as slice, o_totalprice from orders) select slice, count(*) as n, count(*) filter (where o_totalprice > 100000) as matched, percentile_disc(0.5) within group (order by case when o_totalprice > 100000 then o_totalprice end) as p50 from s group by slice")
def ben_02(spark, d):
    s = table(spark, d, "orders").select(F.explode(F.array(F.lit("all"), F.col("o_orderstatus"))).alias("slice"), "o_totalprice")
    counts = s.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("matched"))
    return counts.join(nearest_ranks(s.filter("o_totalprice > 100000"), ["slice"], "o_totalprice", {"p50": 0.5}), "slice", "left")


_RAW = " ".join(f"when s_suppkey % 12 = {i} then '{m}'" for i, m in enumerate(("openai/gpt-5.5-high", "claude-opus-5", "qwen3-coder", "kimi/k2-low", "Gemini-2-max", "o3", "foo/bar-xhigh", "mistral", "k3", "openai/o3-minimal", "llama-4", " anthropic/claude-4-sonnet ")))


@query("scl_01_model_names", f"""with r as (select s_suppkey, trim(case {_RAW} end) as raw from supplier), p as (select *, case when strpos(raw, '/') > 1 then split_part(raw, '/', 1) end as provider, case when strpos(raw, '/') > 1 then substr(raw, strpos(raw, '/') + 1) else raw end as rest from r),
 e as (select *, nullif(regexp_extract(rest, '^.+-(minimal|low|medium|high|xhigh|max)$', 1), '') as effort from p), c as (select *, case when effort is null then rest else substr(rest, 1, length(rest) - length(effort) - 1) end as canonical from e)
 select s_suppkey, canonical as canonical_name, effort as reasoning_effort, provider as service_provider, coalesce(case lower(provider) when 'openai' then 'openai' when 'anthropic' then 'anthropic' when 'kimi' then 'moonshot' end,
  case when regexp_matches(lower(canonical), '^(gpt|chatgpt|o[134])(-|[0-9]|$)|codex-mini') then 'openai' when contains(lower(canonical), 'claude') then 'anthropic' when contains(lower(canonical), 'qwen') then 'alibaba' when regexp_matches(lower(canonical), 'gemini|gemma') then 'google' when contains(lower(canonical), 'llama') then 'meta' when regexp_matches(lower(canonical), 'moonshot|kimi|^k[0-9]') then 'moonshot' else 'unknown' end) as vendor from c""")
def scl_01(spark, d):
    raw = table(spark, d, "supplier").select("s_suppkey", F.expr(f"case {_RAW} end").alias("raw"))
    return raw.select("s_suppkey", M.normalize_model_name(F.col("raw")).alias("n")).select("s_suppkey", "n.*")


@query("scl_02_usage_events", """with e as (select l_orderkey as id, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey as i, case when l_returnflag = 'A' and l_orderkey % 2 = 0 then 'request' when l_returnflag = 'N' then 'turn' else 'session_cumulative' end as scope, case when l_linenumber % 3 <> 0 then cast(l_quantity as bigint) end as input, cast(l_suppkey as bigint) as output from lineitem),
 b as (select *, case scope when 'request' then 0 when 'turn' then 1 else 2 end as p from e), s as (select *, min(p) over (partition by id) as best from b), k as (select * from s where p = best)
 select id, arg_max(scope, i) as scope, cast(case when min(p) = 0 then sum(input) else first(input order by i desc) end as bigint) as input, cast(case when min(p) = 0 then sum(output) else arg_max(output, i) end as bigint) as output from k group by id""")
def scl_02(spark, d):
    l = table(spark, d, "lineitem")
    scope = F.when((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 2 == 0), "request").when(F.col("l_returnflag") == "N", "turn").otherwise("session_cumulative")
    e = l.select(F.col("l_orderkey").alias("id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("i"), scope.alias("scope"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("bigint")).alias("input"), F.col("l_suppkey").alias("output"))
    return X.normalize_usage(e, "id", "i", ["input", "output"])


@query("scl_04_positive_numbers", "select c_custkey, greatest(coalesce(c_acctbal, 0), 0) as v, cast(trunc(c_acctbal) as bigint) as i from customer")
def scl_04(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.positive(F.col("c_acctbal")).alias("v"), N.safe_integer(F.col("c_acctbal")).alias("i"))


@query("scl_07_round6", "select o_orderkey, round(o_totalprice / 7919, 6) as v from orders")
def scl_07(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.round6(F.col("o_totalprice") / 7919).alias("v"))


@query("scl_08_bounded_share", "select s_suppkey, round(case when s_acctbal > 0 and 1000 <= s_acctbal then 1000 / s_acctbal end, 6) as share from supplier")
def scl_08(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", N.round6(N.bounded_cache_share(F.col("s_acctbal"), F.lit(1000.0))).alias("share"))


@query("scl_09_report_project", "select p_partkey, coalesce(nullif(trim(case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then ' ' end), ''), nullif(trim(case when p_partkey % 2 = 0 then p_name end), ''), 'unassigned') as project from part")
def scl_09(spark, d):
    k = F.col("p_partkey")
    repo = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, " ")
    return table(spark, d, "part").select("p_partkey", T.report_project(repo, F.when(k % 2 == 0, F.col("p_name"))).alias("project"))


_RANK = {"ASIA": 0, "EUROPE": 1, "AFRICA": 2}


@query("top_05_enum_order", f"select n_name, r_name, cast(case r_name {' '.join(f'''when '{k}' then {v}''' for k, v in _RANK.items())} else 999 end as bigint) as rank from nation join region on n_regionkey = r_regionkey")
def top_05(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    at = F.array_position(F.array(*(F.lit(k) for k in _RANK)), F.col("r_name"))
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name", F.when(at > 0, at - 1).otherwise(999).cast("bigint").alias("rank"))


@query("top_04_audit_list", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 80")
def top_04(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(80).select("o_orderkey", "o_totalprice")


@query("seg_07_item_classes", """with t as (select *, sum(case when role = 'user' and trim(text) <> '' then 1 else 0 end) over (partition by conv_id order by turn) as turn_no from conversations),
 f as (select *, max(case when role = 'assistant' and trim(text) <> '' then turn end) over (partition by conv_id, turn_no) as final_turn from t)
 select conv_id, turn, case when role in ('system', 'developer') then 'instructions' when role = 'user' then 'human_input' when role = 'assistant' and turn = final_turn then 'assistant_final' when role = 'assistant' then 'assistant_other' else 'unknown' end as category,
  case when role in ('system', 'developer') then 'structural_instruction' when role = 'user' then 'human_structural_evidence' when role = 'assistant' and turn = final_turn then 'harness_final_evidence' when role = 'assistant' then 'visible_assistant_text' else 'unclassified_canonical_kind' end as reason from f""")
def seg_07(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    items = c.withColumns({"kind": F.lit("text"), "human": F.when(F.col("role") == "user", True), "visible": F.lit(True)})
    return X.classify_items(items, "conv_id", "turn").select("conv_id", "turn", "category", "reason")


@query("imp_01_wait_imputation")
def imp_01(spark, d):
    """Waits of dialogues without a measured one, from their nearest donors; tests hold it against a plain loop."""
    m = messages(spark, d)
    wait = F.sum(F.when(F.col("human_authored") & (F.col("wait_ms") > 90_000), F.col("wait_ms")))
    g = m.groupBy("dialogue_id").agg(F.count_if("has_usage").alias("calls"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output"), wait.alias("wait_ms"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("api_ms"), F.max("model_key").alias("model"))
    return I.impute_waits(g)
