"""Scans, syncs, record streams, stored indexes, preflight and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import ann as A
from parley.operators import commits as C
from parley.operators import evaluation as E
from parley.operators import inverted as V
from parley.operators import preflight as P
from parley.operators import retrieval as R
from parley.operators.storage import settled, shared_path
from parley.plans.search_queries import _BM, _BM25, _COS, _RANKED, _bm25, _queries
from parley.plans.storage_queries import _LINE, _tree_sql
from parley.plans.tables import query, table
from parley.sources.records import RecordStream, as_records
from parley.sources.scans import scan_roots
from parley.streaming import presence as S
from parley.streaming.ingest import sync

TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")

# ------------------------------------------------------------------ scans and syncs


@query("src_02_scan_status", " union all ".join(f"select 'tables' as root, 'complete' as status, '{t}' as name" for t in TABLES) + " union all select 'absent', 'unavailable', null")
def src_02(spark, d):
    """The tables' own files, by the table they belong to, and a root that isn't there."""
    status, files = scan_roots(spark, [d, f"{d}/absent"])
    root = F.when(F.col("root") == d, "tables").otherwise("absent")
    name = F.regexp_extract("relative_path", r"^(\w+)\.parquet", 1).alias("name")
    return status.join(files.select("root", name).distinct(), "root", "left").select(root.alias("root"), "status", "name")


_SEEN = {1: "true", 2: "page_id % 7 <> 0", 3: "page_id % 2 = 0", 4: "page_id % 7 <> 0 and page_id % 11 <> 0", 5: "page_id % 7 <> 0 and page_id % 5 <> 0"}


def _scans(pages):
    """Five scans of the pages as files; the third one isn't complete and the second finds a fifth of them changed."""
    out = None
    for scan, seen in _SEEN.items():
        known = pages.filter(seen).select(F.col("url").alias("path"), F.sha2(F.when((F.lit(scan) >= 2) & (F.col("page_id") % 5 == 0), F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("fingerprint"))
        mark = pages.sparkSession.createDataFrame([(None, None)], "path string, fingerprint string")
        rows = known.unionByName(mark).select(F.lit("site").alias("root"), F.lit(scan).cast("bigint").alias("scan"), F.lit(scan != 3).alias("complete"), "path", "fingerprint")
        out = rows if out is None else out.unionByName(rows)
    return out


_STEPS = """select page_id, 1 as scan, 'new' as action, 'active' as presence, 0 as missed from pages
 union all select page_id, 2, case when page_id % 7 = 0 then 'missing' when page_id % 5 = 0 then 'changed' else 'unchanged' end, case when page_id % 7 = 0 then 'missing' else 'active' end, case when page_id % 7 = 0 then 1 else 0 end from pages
 union all select page_id, 3, case when page_id % 7 = 0 then 'returned' else 'unchanged' end, 'active', 0 from pages where page_id % 2 = 0
 union all select page_id, 4, case when page_id % 7 = 0 or page_id % 11 = 0 then 'missing' else 'unchanged' end, case when page_id % 7 = 0 and page_id % 2 = 1 then 'deleted' when page_id % 7 = 0 or page_id % 11 = 0 then 'missing' else 'active' end, case when page_id % 7 = 0 and page_id % 2 = 1 then 2 when page_id % 7 = 0 or page_id % 11 = 0 then 1 else 0 end from pages
 union all select page_id, 5, case when page_id % 7 = 0 or page_id % 5 = 0 then 'missing' when page_id % 11 = 0 then 'returned' else 'unchanged' end,
  case when page_id % 7 = 0 then 'deleted' when page_id % 5 = 0 and page_id % 11 = 0 then 'deleted' when page_id % 5 = 0 then 'missing' else 'active' end,
  case when page_id % 7 = 0 and page_id % 2 = 1 then 3 when page_id % 7 = 0 then 2 when page_id % 5 = 0 and page_id % 11 = 0 then 2 when page_id % 5 = 0 then 1 else 0 end from pages"""


@query("str_02_presence_stream", f"select page_id, scan, action, presence, missed from ({_STEPS})")
def str_02_stream(spark, d):
    """Scans arrive in two calls, the second of which sends an old one again; two scans that miss a file delete it."""
    pages = table(spark, d, "pages").select("page_id", F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("url"), "html")
    scans, base = _scans(pages), shared_path(spark, "presence")
    for chosen in ("scan <= 2", "scan >= 2"):
        scans.filter(chosen).write.mode("append").parquet(f"{base}/scans")
        S.run_presence(spark, f"{base}/scans", f"{base}/moves", f"{base}/state", 2)
    S.run_presence(spark, f"{base}/scans", f"{base}/moves", f"{base}/state", 2)
    moves = spark.read.parquet(f"{base}/moves")
    return moves.join(pages.select("page_id", F.col("url").alias("path")), "path").select("page_id", "scan", "action", "presence", "missed")


@query("str_01_incremental_sync", """select doc_id, md5(case when doc_id % 10 = 0 then concat(text, ' v2') else text end) as digest, case when doc_id % 10 = 0 or doc_id % 2 = 1 then 2 else 1 end as arrival, 2 as version,
 case when doc_id % 2 = 1 or doc_id % 10 = 0 then 'active' else 'deleted' end as presence from documents""")
def str_01(spark, d):
    """Two arrivals, the second with new and changed documents; a rerun; then the first arrival's file vanishes from its root."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    base = shared_path(spark, "sync")
    target = C.CommitTable(spark, f"{base}/table", ["doc_id"])
    first = docs.filter("doc_id % 2 = 0").withColumn("arrival", F.lit(1))
    second = docs.filter("doc_id % 2 = 1").unionByName(docs.filter("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" v2")))).withColumn("arrival", F.lit(2))
    scans = []
    for n, rows in ((1, first), (2, second)):
        rows.write.mode("append").parquet(f"{base}/arrivals")
        for _ in range(2):
            version = sync(spark, f"{base}/arrivals", "doc_id bigint, text string, arrival int", target, f"{base}/state", ["arrival"])
        scans.append((n, [1, 2][:n]))
    # What is in the folder is a file an arrival; two complete scans then find the second alone.
    for n in (3, 4):
        scans.append((n, [2]))
    rows = [("arrivals", n, True, f"arrival-{a}" if a else None, "f") for n, seen in scans for a in (*seen, None)]
    spark.createDataFrame(rows, "root string, scan bigint, complete boolean, path string, fingerprint string").write.parquet(f"{base}/scans")
    S.run_presence(spark, f"{base}/scans", f"{base}/moves", f"{base}/presence", 2)
    now = S.present(spark.read.parquet(f"{base}/moves")).select(F.regexp_extract("path", r"(\d+)$", 1).cast("int").alias("arrival"), "presence")
    target.vacuum()
    held = target.read().select("doc_id", F.md5("text").alias("digest"), "arrival")
    return held.join(now, "arrival").select("doc_id", "digest", "arrival", F.lit(version).alias("version"), "presence")


# ------------------------------------------------------------------ record streams

STREAM = {
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}


def _stream(spark, d) -> RecordStream:
    """Three tables as one stream of lines, and what was split from it."""
    rows = [as_records(table(spark, d, "conversations"), "conversations", ["conv_id", "turn"]), as_records(table(spark, d, "documents"), "documents", ["doc_id"]), as_records(table(spark, d, "labels"), "labels", ["doc_id"])]
    base = shared_path(spark, "stream")
    rows[0].unionByName(rows[1]).unionByName(rows[2]).repartition(F.xxhash64("value")).write.option("compression", "gzip").text(base)
    return RecordStream(spark, base, STREAM)


@query("src_16_record_stream", """select 'documents' as tab, doc_id as id, 0::bigint as turn, md5(concat_ws('|', text, lang, source, n_chars)) as digest from documents
 union all select 'conversations', conv_id, turn, md5(concat_ws('|', role, text)) from conversations union all select 'labels', doc_id, 0, md5(concat_ws('|', quality, toxic)) from labels""")
def src_16(spark, d):
    """Every record of the stream in its table, equal to the row that it was made of."""
    s = _stream(spark, d)
    text = lambda c: F.col(c).cast("string")
    docs = s.table("documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), F.md5(F.concat_ws("|", "text", "lang", "source", text("n_chars"))).alias("digest"))
    said = s.table("conversations").select(F.lit("conversations").alias("tab"), F.col("conv_id").alias("id"), "turn", F.md5(F.concat_ws("|", "role", "text")).alias("digest"))
    labels = s.table("labels").select(F.lit("labels").alias("tab"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), F.md5(F.concat_ws("|", text("quality"), text("toxic"))).alias("digest"))
    return docs.unionByName(said).unionByName(labels)


# ------------------------------------------------------------------ stored indexes


def _vector_queries(vectors):
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("top_02_ann_recall", f"with {_COS} select query_id, count(*) as wanted, true as enough, true as scored_alike from cr where rank <= 50 group by query_id")
def top_02_ann(spark, d):
    """Recall at 50 of the cells against the exact search, for every row whose id is divisible by 100: 0.95 or more together;
    a shared hit has the exact score."""
    v, path = table(spark, d, "embeddings"), shared_path(spark, "cells")
    A.build_index(v, path)
    exact = R.cosine_search(v, _vector_queries(v), 50)
    found = A.search(spark, path, _vector_queries(v), 50)
    both = exact.join(found.select("query_id", "doc_id", F.col("score").alias("own")), ["query_id", "doc_id"], "left")
    g = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("own").alias("found"), F.bool_and(F.coalesce(F.abs(F.col("score") - F.col("own")) < 1e-5, F.lit(True))).alias("scored_alike"))
    g = settled(g, "recall")
    whole = g.agg((F.sum("found") >= 0.95 * F.sum("wanted")).alias("enough"))
    return g.crossJoin(whole).select("query_id", "wanted", "enough", "scored_alike")  # one row on the right


@query("top_02_ann_filtered", f"with {_COS} select query_id, count(*) as wanted, true as enough from (select c.*, row_number() over (partition by query_id order by score desc, doc_id) as nth from c join embeddings on vec_id = doc_id where label % 3 = 0) where nth <= 20 group by query_id")
def top_02_filtered(spark, d):
    """The same index files under a filter that leaves a third of the rows: over-fetching keeps recall at 20 at 0.95 or more."""
    v, path = table(spark, d, "embeddings"), shared_path(spark, "cells")
    A.build_index(v, path)
    where = F.col("label") % 3 == 0
    exact = R.cosine_search(v.filter(where), _vector_queries(v), 20)
    g = settled(A.recall(A.search(spark, path, _vector_queries(v), 20, where), exact), "recall")
    whole = g.agg((F.sum("found") >= 0.95 * F.sum("wanted")).alias("enough"))
    return g.crossJoin(whole).select("query_id", "wanted", "enough")


@query("val_05_bm25_probe", _BM25.replace("select query_id, doc_id, round(score, 6) as score from", "select query_id, doc_id, round(score, 6) as score, true as agrees from") + " where m = nt")
def val_05(spark, d):
    """The stored index asked for every benchmark item, beside a scan of the texts: hits and scores must agree."""
    docs, path = table(spark, d, "documents"), shared_path(spark, "inverted")
    V.build_inverted(docs, path)
    found = V.Inverted(spark, path).bm25(_queries(spark, d))
    scan = _bm25(spark, d, True)
    both = found.select("query_id", "doc_id", F.col("score").alias("a")).join(scan.select("query_id", "doc_id", F.col("score").alias("b")), ["query_id", "doc_id"], "full")
    return both.select("query_id", "doc_id", F.coalesce("a", "b").alias("score"), F.coalesce(F.abs(F.col("a") - F.col("b")) < 2e-6, F.lit(False)).alias("agrees"))


@query("top_01_indexed_topk", _RANKED + " select query_id, doc_id, score, rank from r where rank <= 10")
def top_01_indexed(spark, d):
    """The ten best of any term from the stored index; blocks that can't reach them stay packed."""
    path = shared_path(spark, "inverted")
    V.build_inverted(table(spark, d, "documents"), path)
    return V.Inverted(spark, path).top(_queries(spark, d), 10)


# ------------------------------------------------------------------ preflight

_LEGACY = """a as (select n_nationkey as agent_id from nation), t as (select o_orderkey as thread_id, o_custkey % 500 as external_id, o_custkey % 30 as agent_id, case when o_custkey % 11 = 0 then null when o_custkey % 17 = 0 then -o_custkey else o_custkey end as project_id,
 case o_orderkey % 4 when 0 then 'macos' when 1 then 'linux' when 2 then 'windows' else 'unknown' end as host from orders),
 r as (select l_orderkey + case when l_partkey % 97 = 0 then 100000000 else 0 end as thread_id, case when l_partkey % 13 <> 0 then l_suppkey end as file, l_partkey % 10 > 0 as present, l_partkey % 10 > 1 as valid from lineitem),
 b as (select s_suppkey as file from supplier where s_suppkey % 4 <> 0), k as (select thread_id, count(*) as n, count(*) filter (where valid) as valid, count(distinct r.file) as files, count(distinct b.file) as kept from r left join b on r.file = b.file group by thread_id),
 j as (select t.*, k.n, k.valid, k.files, k.kept from t left join k using (thread_id))"""


@query("mig_01_preflight", f"""with {_LEGACY} select 'threads' as figure, count(*) as n from t union all select 'records', count(*) from r union all select 'payload_present', count(*) from r where present union all select 'payload_valid', count(*) from r where valid
 union all select 'records_without_file', count(*) from r where file is null union all select 'threads_without_agent', count(*) from t where agent_id not in (select agent_id from a) union all select 'threads_without_project', count(*) from t where project_id is not null and project_id not in (select c_custkey from customer)
 union all select 'records_without_thread', count(*) from r where thread_id not in (select thread_id from t) union all select 'threads_covered', count(*) from j where n > 0 and valid = n union all select 'threads_covered_in_part', count(*) from j where valid > 0 and valid < n
 union all select 'threads_uncovered', count(*) from j where coalesce(valid, 0) = 0 union all select 'threads_with_all_backups', count(*) from j where files > 0 and kept = files union all select 'threads_repeated', cast(sum(c - 1) as bigint) from (select count(*) as c from t group by agent_id, external_id) union all select 'host:' || host, count(*) from t group by host""")
def mig_01(spark, d):
    """Orders as threads and line items as their records: every table is read once."""
    t = lambda n: table(spark, d, n)
    path = "case o_orderkey % 4 when 0 then '/Users/ann/x.jsonl' when 1 then '/home/ann/x.jsonl' when 2 then 'C:\\\\Users\\\\ann\\\\x' else 'x.jsonl' end as path"
    threads = t("orders").selectExpr("o_orderkey as thread_id", "o_custkey % 500 as external_id", "o_custkey % 30 as agent_id", "case when o_custkey % 11 = 0 then null when o_custkey % 17 = 0 then -o_custkey else o_custkey end as project_id", path)
    payload = """case l_partkey % 10 when 0 then '' when 1 then '{"broken' else concat('{"q":', l_quantity, '}') end as payload"""
    records = t("lineitem").selectExpr("l_orderkey + case when l_partkey % 97 = 0 then 100000000 else 0 end as thread_id", "case when l_partkey % 13 <> 0 then l_suppkey end as source_file_id", payload)
    return P.preflight(t("nation").selectExpr("n_nationkey as agent_id"), t("customer").selectExpr("c_custkey as project_id"), threads, records, t("supplier").filter("s_suppkey % 4 <> 0").selectExpr("s_suppkey as source_file_id"))


# ------------------------------------------------------------------ evaluation

_JUDGED = "j as (select item_id as query_id, doc_id, cast(item_id % 3 + 1 as int) as grade from benchmark join documents on contains(documents.text, benchmark.text)), jq as (select distinct query_id from j)"


def _judgments(spark, d):
    """Items that documents hold, as queries; the documents that hold them are what is expected."""
    items, docs = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    index = shared_path(spark, "judged")
    V.build_inverted(table(spark, d, "documents"), index)
    inverted = V.Inverted(spark, index)
    # Documents with all words of an item, then those that hold it as it stands.
    found = settled(inverted.bm25(items).select("query_id", "doc_id"), "found")
    pairs = found.join(items, "query_id").join(docs, "doc_id").filter(F.contains("body", "text"))
    expected = settled(pairs.select("query_id", "doc_id", (F.col("query_id") % 3 + 1).cast("int").alias("grade")), "expected")
    queries = items.join(expected, "query_id", "left_semi").withColumns({"language": F.lit("en"), "query_type": F.lit("exact phrase")})
    return inverted, queries, expected


@query("eval_04_judgment_problems", f"with {_JUDGED} select cast(null as bigint) as query_id, 'number_of_queries' as problem where (select count(*) from jq) not between 50 and 100 union all select query_id, 'language' from jq where query_id % 4 = 0 union all select query_id, 'nothing_expected' from jq where query_id % 5 = 0 union all select query_id, 'nothing_forbidden' from jq where query_id % 6 = 0 union all select distinct query_id, 'grade' from j where grade = 3 and query_id % 5 <> 0")
def eval_04(spark, d):
    """What is wrong with a set that was spoilt in four ways."""
    _, queries, expected = _judgments(spark, d)
    queries = queries.withColumn("language", F.when(F.col("query_id") % 4 == 0, "xx").otherwise(F.col("language")))
    expected = expected.filter("query_id % 5 <> 0").withColumn("grade", F.when(F.col("grade") == 3, 4).otherwise(F.col("grade")))
    must_not = queries.select("query_id", F.when(F.col("query_id") % 6 == 0, " ").otherwise("x").alias("text"))
    return E.judgment_problems(queries, expected, must_not)


@query("eval_05_scenarios", f"""with {_BM}, {_JUDGED}, lines as (select row_number() over (order by doc_id) - 1 as rank, {_LINE} as digest from documents), {_tree_sql('lines')}, root as (select digest from levels order by level desc limit 1),
 r as (select 'any term' as scenario, query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from h where query_id in (select query_id from jq) union all
  select 'all terms', query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) from h join k using (query_id) where m = nt and query_id in (select query_id from jq)),
 i as (select query_id, count(*) as n, sum(case when x <= 10 then (pow(2, grade) - 1) / log2(x + 1) end) as ideal from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as x from j) group by query_id),
 g as (select scenario, r.query_id, count(grade) filter (where rank <= 5) as f5, count(grade) filter (where rank <= 10) as f10, min(rank) filter (where grade is not null and rank <= 10) as fr, sum((pow(2, grade) - 1) / log2(rank + 1)) filter (where rank <= 10) as dcg,
  count(*) filter (where grade is null and rank <= 5) as w5, count(*) filter (where rank <= 5) as n5 from r left join j using (query_id, doc_id) where rank <= 50 group by all)
 select g.scenario, query_id, round(f5 / n, 6) as recall5, round(f10 / n, 6) as recall10, round(coalesce(1.0::double / fr, 0), 6) as mrr, round(case when ideal > 0 then coalesce(dcg, 0) / ideal else 0 end, 6) as ndcg10, round(case when n5 > 0 then w5 / n5 else 1 end, 6) as irrelevant5, 0 as forbidden, (select digest from root) as corpus from i join g using (query_id)""")
def eval_05(spark, d):
    """Two ways to search, measured on a corpus whose digest is held to before and after each."""
    inverted, queries, expected = _judgments(spark, d)
    docs = lambda: table(spark, d, "documents").select("doc_id", "text")
    ways = {"any term": lambda q: inverted.top(q, 50), "all terms": lambda q: R.top_k(inverted.bm25(q), 50, ["query_id"])}
    never = queries.select("query_id", F.lit("\u0001 no document has this").alias("text"))
    return E.run_scenarios(docs, ways, queries, expected, never, E.corpus_digest(docs()), least=1, most=1_000_000)
