"""State of an archive: reconciled files, copies across roots, raw rules, leases, replays; and vectors of all coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import numbers as N
from parley.operators import digests as D
from parley.operators import lineage as L
from parley.operators import projections as P
from parley.operators import reconcile as C
from parley.operators import retrieval as R
from parley.operators import searching as G
from parley.operators import validation as V
from parley.operators.storage import settled
from parley.plans.record_queries import _MATRIX
from parley.plans.search_queries import _BM
from parley.plans.storage_queries import _tree_sql
from parley.plans.tables import EVT, events, query, table

# ------------------------------------------------------------------ files

_BEFORE = "select url || '#' || page_id as path, sha256(html) as h, strlen(html) as n, case when page_id % 13 = 0 then 'missing' when page_id % 17 = 0 then 'deleted' else 'active' end as was, case when page_id % 13 = 0 then 2 when page_id % 17 = 0 then 5 else 0 end as missed from pages where page_id % 9 <> 0"
_NOW = "select url || '#' || page_id as path, sha256(case when page_id % 5 = 0 then html || '!' else html end) as h, strlen(html) + case when page_id % 5 = 0 then 1 else 0 end as n from pages where page_id % 8 <> 0"


@query("join_10_reconcile", f"""with p as ({_BEFORE}), s as ({_NOW}) select coalesce(p.path, s.path) as path, case when p.path is null then 'new' when s.path is null then 'missing' when was <> 'active' then 'returned' when p.h <> s.h then 'changed' else 'unchanged' end as action,
 case when s.path is not null then 'active' when was = 'deleted' or missed + 1 >= 3 then 'deleted' else 'missing' end as presence, case when s.path is not null then 0 else missed + 1 end as missed from p full join s on p.path = s.path""")
def join_10(spark, d):
    """What an archive knew of the pages' files against a complete scan that found some gone, some new and some changed."""
    pages = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), "html")
    mark = lambda x: F.struct(F.sha2(x, 256).alias("sha256"), F.octet_length(x).alias("size_bytes"), F.lit(0).alias("mtime_ms"), F.lit(None).cast("string").alias("head_hash"))
    was = F.when(F.col("page_id") % 13 == 0, "missing").when(F.col("page_id") % 17 == 0, "deleted").otherwise("active")
    missed = F.when(F.col("page_id") % 13 == 0, 2).when(F.col("page_id") % 17 == 0, 5).otherwise(0)
    before = pages.filter("page_id % 9 <> 0").select("path", was.alias("presence"), missed.alias("missed"), mark(F.col("html")).alias("f"))
    now = pages.filter("page_id % 8 <> 0").select("path", mark(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).alias("f"))
    return C.reconcile(before, now, "path", True).select("path", "action", "presence", "missed")


@query("dup_01_cross_root", """with x as (select doc_id, source as root, case when doc_id % 3 <> 0 then lang end as device, doc_id // 2 as inode, sha256(text) as h from documents),
 a as (select x.* from x left join (select device, inode, arg_min(root, (root, doc_id)) as first from x where device is not null group by all) f on x.device = f.device and x.inode = f.inode where first is null or first = root),
 b as (select h, arg_min(root, (root, doc_id)) as first from a group by h) select doc_id, root from a join b using (h) where root = first""")
def dup_01(spark, d):
    """Documents as files of twenty roots: a file that another root holds, by its place on disk or its content, is left out."""
    x = table(spark, d, "documents").select("doc_id", F.col("source").alias("root"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("device"), F.floor(F.col("doc_id") / 2).alias("inode"), F.sha2("text", 256).alias("sha256"))
    return C.first_copies(x, ["root", "doc_id"]).select("doc_id", "root")


@query("raw_01_manifest", f"""with p as (select row_number() over (order by url, page_id) - 1 as rank, page_id, url, sha256(html) as sha, strlen(html) as n_bytes from pages), r as (select rank, sha256(concat(length(path), ':', path, 'S', length(sha), ':', sha, ';')) as digest from (select *, url || '#' || page_id as path from p)), {_tree_sql('r')}
 select page_id, url, sha, n_bytes, rank, (select digest from levels order by level desc limit 1) as manifest_sha256 from p""")
def raw_01(spark, d):
    """Raw files in the order of path and id, with the digest of the whole manifest."""
    pages = table(spark, d, "pages").select("page_id", "url", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("bigint").alias("n_bytes"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"))
    ranked = D.in_order(pages, ["url", "page_id"])
    root = D.roots(D.tree(ranked.select("rank", D.payload("path", "sha").alias("digest")))).first()
    return ranked.select("page_id", "url", "sha", "n_bytes", "rank", F.lit(root.digest if root else None).alias("manifest_sha256"))


@query("val_03_raw_rules", """with m as (select page_id as id, case when page_id % 41 = 0 then null when page_id % 31 = 0 then sha256(url) else sha256(html) end as h, strlen(html) + case when page_id % 29 = 0 then 1 else 0 end as n from pages where page_id % 37 <> 1), s as (select page_id as id, sha256(html) as h, strlen(html) as n from pages where page_id % 23 <> 1), j as (select m.id as a, s.id as b, m.h as mh, s.h as sh, m.n as mn, s.n as sn from m full join s on m.id = s.id)
 select 'raw_missing' as rule, count(*) as n from j where b is null union all select 'raw_orphan', count(*) from j where a is null union all select 'raw_hash_mismatch', count(*) from j where mh <> sh union all select 'raw_size_mismatch', count(*) from j where mn <> sn union all select 'raw_hash_unknown', count(*) from j where a is not null and mh is null""")
def val_03(spark, d):
    """A manifest of the pages with wrong digests and sizes and lost rows, against what is stored."""
    p = table(spark, d, "pages")
    h = F.when(F.col("page_id") % 41 == 0, F.lit(None)).when(F.col("page_id") % 31 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256))
    manifest = p.filter("page_id % 37 <> 1").select(F.col("page_id").alias("id"), h.alias("sha256"), (F.octet_length("html") + F.when(F.col("page_id") % 29 == 0, 1).otherwise(0)).alias("size_bytes"))
    stored = p.filter("page_id % 23 <> 1").select(F.col("page_id").alias("id"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").alias("size_bytes"))
    return V.raw_rules(manifest, stored)


@query("mig_02_recovery_source", """select doc_id, case when p.page_id is not null then 'raw' when e.vec_id is not null then 'payload' when l.doc_id is not null then 'normalized' else 'quarantine' end as recovery from documents left join pages p on p.page_id = doc_id and length(p.html) > 0 left join embeddings e on e.vec_id = doc_id left join (select distinct doc_id from labels) l using (doc_id)""")
def mig_02(spark, d):
    """Where each document can be recovered from: its raw page, a payload, or normalized rows alone."""
    t = lambda n, c: table(spark, d, n).select(F.col(c).alias("doc_id")).distinct().withColumn(n, F.lit(True))
    raw = table(spark, d, "pages").filter(F.length("html") > 0).select(F.col("page_id").alias("doc_id")).distinct().withColumn("pages", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id").join(raw, "doc_id", "left").join(t("embeddings", "vec_id"), "doc_id", "left").join(t("labels", "doc_id"), "doc_id", "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("doc_id", V.recovery_source(has("pages"), has("embeddings"), has("labels")).alias("recovery"))


@query("doc_01_stuck_leases", """with j as (select o_orderkey, case o_orderstatus when 'P' then 'leased' when 'O' then 'pending' else 'completed' end as status, case when o_orderkey % 7 <> 0 then o_orderdate + to_days(30) end as locked_until from orders), n as (select max(o_orderdate) as now from orders)
 select o_orderkey, epoch_ms(now) - epoch_ms(locked_until) as overdue_ms from j, n where status = 'leased' and (locked_until is null or locked_until < now)""")
def doc_01(spark, d):
    """Orders as jobs that are leased for thirty days, looked at when the last one came."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "leased").when(F.col("o_orderstatus") == "O", "pending").otherwise("completed")
    jobs = o.select("o_orderkey", status.alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.expr("cast(o_orderdate as timestamp) + interval 30 days")).alias("locked_until"))
    now = F.lit(o.agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])
    return C.stuck_leases(jobs, now).select("o_orderkey", "overdue_ms")


# ------------------------------------------------------------------ replays


@query("scl_12_without_replay", f"with {EVT}, r as (select user_id, event_type, max(k) as top from evt group by all) select event_id, case when k - least(k, coalesce(top, 0)) > 0 then k - least(k, coalesce(top, 0)) end as rest from evt left join (select user_id + 1 as user_id, event_type, top from r) p using (user_id, event_type)")
def scl_12(spark, d):
    """An event's figure without what the user before had of its kind at most."""
    e = events(spark, d)
    before = e.groupBy((F.col("user_id") + 1).alias("user_id"), "event_type").agg(F.max("k").alias("replayed"))
    return e.join(before, ["user_id", "event_type"], "left").select("event_id", N.without_replay(F.col("k"), F.col("replayed")).alias("rest"))


@query("lin_02_replay_walk", """with recursive o as (select user_id, event_type as key, row_number() over (partition by user_id order by ts, event_id) as i from events), x as (select user_id - 1 as child, i as j, key from o),
 n as (select child, max(j) as n from x group by child), m as (select o.user_id as child, o.i, o.key, coalesce(n.n, 0) as n from o left join n on n.child = o.user_id),
 p as (select x.child, x.j as pos, k.key from x, (select distinct key from o) k where x.key is not null union all select n.child, 0, k.key from n, (select distinct key from o) k),
 nxt as (select distinct p.child, p.pos, p.key, (select min(x.j) from x where x.child = p.child and x.key = p.key and x.j > p.pos) as j from p),
 w as (select child, 0::bigint as i, 0::bigint as pos, null::varchar as last, false as replayed, null::varchar as key from (select distinct child from m)
 union all select m.child, m.i, case when w.pos >= m.n or m.key = w.last then w.pos when nxt.j is not null then nxt.j else m.n end, case when w.pos >= m.n or m.key = w.last or nxt.j is null then w.last else m.key end,
 w.pos < m.n and (coalesce(m.key = w.last, false) or nxt.j is not null), m.key from w join m on m.child = w.child and m.i = w.i + 1 left join nxt on nxt.child = m.child and nxt.key = m.key and nxt.pos = w.pos)
 select child, i as sequence, key, replayed from w where i > 0""")
def lin_02(spark, d):
    """Each user's events walked along all of the next user's."""
    o = events(spark, d).withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))
    expected = o.select((F.col("user_id") - 1).alias("child"), F.col("i").alias("n"), F.col("event_type").alias("key"))
    return L.map_replays(o.select(F.col("user_id").alias("child"), F.col("i").alias("sequence"), F.col("event_type").alias("key")), expected)


# ------------------------------------------------------------------ vectors

_COORDINATES = "c as (select label, unnest(range(0, 64)) as coordinate, unnest(embedding)::double as x from embeddings)"


def _coordinates(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("coordinate", "x")).withColumns({"x": F.col("x").cast("double"), "coordinate": F.col("coordinate").cast("bigint")})


@query("clu_10_cluster_profiles", f"with {_COORDINATES} select cast(label as bigint) as label, coordinate, count(*) as n, round(avg(x), 6) as mean, round(min(x), 6) as low, round(max(x), 6) as high from c group by all")
def clu_10(spark, d):
    g = _coordinates(spark, d).groupBy("label", "coordinate")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"))


@query("clu_11_linear_percentiles", f"with {_COORDINATES} select cast(label as bigint) as label, coordinate, round(quantile_cont(x, 0.1), 6) as p10, round(quantile_cont(x, 0.5), 6) as p50, round(quantile_cont(x, 0.9), 6) as p90 from c group by all")
def clu_11(spark, d):
    g = _coordinates(spark, d).groupBy("label", "coordinate")
    return g.agg(*(F.round(F.percentile("x", p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)))


@query("clu_08_principal_axes")
def clu_08(spark, d):
    """Two principal axes of all vectors; a test holds their plane and variance against a decomposition."""
    p, _ = P.principal_axes(table(spark, d, "embeddings"), 2)
    return p.select("vec_id", F.col("axes")[0].alias("x"), F.col("axes")[1].alias("y"))


_SHADOW = ", ".join(f"list_dot_product(e, [{', '.join(repr(float(x)) for x in _MATRIX[:, j])}]::double[])" for j in range(_MATRIX.shape[1]))


@query("clu_12_projection_error", f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), s as (select vec_id, e, [{_SHADOW}] as p from v),
 j as (select list_cosine_similarity(a.e, b.e) as exact, list_cosine_similarity(a.p, b.p) as shadow from s a join s b on b.vec_id = a.vec_id + 1) select round(corr(exact, shadow), 5) as pearson, round(avg(abs(exact - shadow)), 5) as mae, count(*) as pairs from j""")
def clu_12(spark, d):
    """Similarities of neighbours by id, in full and after the random projection."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), P.random_projection(F.col("embedding"), *np.shape(_MATRIX)).alias("p"))
    near = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("e2"), F.col("p").alias("p2"))
    pairs = v.join(near, "vec_id").select(R.cosine(F.col("e"), F.col("e2")).alias("exact"), R.cosine(F.col("p"), F.col("p2")).alias("shadow"))
    n = pairs.agg(F.corr("exact", "shadow").alias("pearson"), F.avg(F.abs(F.col("exact") - F.col("shadow"))).alias("mae"), F.count(F.lit(1)).alias("pairs"))
    return n.select(F.round("pearson", 5).alias("pearson"), F.round("mae", 5).alias("mae"), "pairs")


# ------------------------------------------------------------------ search end to end

_ASKED = "the of"
#: Name of a search -> (the condition on context, the filters).
SEARCHES = {
    "all": ("true", {}), "harness": ("lang = 'en'", {"harness": "en"}), "host": ("source = 'src3' or doc_id % 4 = 3", {"host": "src3"}), "user": ("doc_id % 5 = 2", {"user": "u2"}), "workspace": ("doc_id % 7 = 1", {"workspace": "w1"}),
    "vendor": ("doc_id % 3 = 1 or (doc_id % 3 = 0 and doc_id % 2 = 1)", {"vendor": "v1"}), "model": ("doc_id % 11 = 4 or doc_id % 13 = 4 or doc_id % 17 = 4", {"model": "m4"}), "effort_role": ("doc_id % 2 = 0 and doc_id % 3 = 0", {"effort": "high", "role": "user"}),
    "deleted": ("doc_id % 6 = 0", {"deleted_only": True}), "type": ("doc_id % 4 = 1", {"document_type": "assistant_final"}),
}


def _context(spark, d):
    """Each document with the columns that the twelve filters ask for."""
    n = F.col("doc_id")
    s = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    none = F.lit(None)
    return table(spark, d, "documents").select(
        "doc_id", (n % 900).alias("message_id"), (n % 40).alias("dialogue_id"), F.col("lang").alias("harness"), F.when(n % 4 == 3, "src3").otherwise("other").alias("hostname"), F.col("source").alias("host_label"), s("u", n % 5).alias("user"),
        s("w", n % 7).alias("workspace"), F.when(n % 3 > 0, s("v", n % 3)).alias("vendor"), s("v", n % 2).alias("dialogue_vendor"), s("m", n % 11).alias("model"), s("m", n % 13).alias("raw_model"), F.array(s("m", n % 17)).alias("model_aliases"),
        F.when(n % 2 == 0, "high").otherwise("low").alias("effort"), F.when(n % 3 == 0, "user").otherwise("assistant").alias("role"), none.cast("timestamp").alias("message_ts"), F.timestamp_seconds(n * 3600).alias("updated_at"),
        F.when(n % 6 == 0, "deleted").otherwise("active").alias("presence"), F.when(n % 4 == 1, "assistant_final").otherwise("user_prompt").alias("document_type"),
    )


_ONE = _BM.replace("select item_id as query_id, ", "select 0 as query_id, ").replace("from benchmark)", f"from (select '{_ASKED}' as text))")
_FOUND = " union all ".join(f"select '{name}' as search, doc_id from documents where {test}" for name, (test, _) in SEARCHES.items())


@query("flt_02_search_end_to_end", f"""with {_ONE}, f as ({_FOUND}), b as (select search, doc_id, round(score, 6) as score from h join k using (query_id) join f using (doc_id) where m = nt), r as (select *, row_number() over (partition by search order by score desc, doc_id) as rank from b),
 c as (select * from r where rank <= 60), u as (select * from (select *, row_number() over (partition by search, doc_id % 900 order by rank) as nth from c) where nth = 1), v as (select *, row_number() over (partition by search, doc_id % 40 order by rank) as mth from u),
 w as (select *, row_number() over (partition by search order by rank) as pth from v where mth <= 3) select search, doc_id, score, rank from w where pth <= 20""")
def flt_02(spark, d):
    """One search under each filter: BM25, a hit a message, three a dialogue, the first twenty.

    Hybrid without vectors is text, so half of the searches ask for that.
    """
    docs = table(spark, d, "documents")
    terms = _ASKED.split()
    # Texts are analysed once, for all searches.
    rows = settled(R.tokens(docs, "doc_id", "text", terms), "tokens")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    index = settled(R.counted(rows), "postings")
    context, out = _context(spark, d), None
    for i, (name, (_, wanted)) in enumerate(SEARCHES.items()):
        filters = G.SearchFilters(**wanted)
        hits = G.search(index, stats["n"], stats["avgdl"] or 1.0, context, _ASKED, filters if filters.any() else None, "hybrid" if i % 2 else "text")
        hits = hits.select(F.lit(name).alias("search"), "doc_id", "score", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


@query("ret_03_snippets", "select doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(the|de)($|[^\\p{L}\\p{N}])') or contains(lower(text), 'the') or contains(lower(text), 'de') as has_term, true as inside, true as short from documents")
def ret_03(spark, d):
    """A snippet of every document: it is text of the document, marks whole terms alone, and is no longer than it may be."""
    text, s = F.col("text"), G.snippet(F.col("text"), ["the", "de"])
    plain = F.regexp_replace(F.regexp_replace(s, "</?em>", ""), "^…|…$", "")
    low = F.lower(text)
    return table(spark, d, "documents").select("doc_id", (F.contains(low, F.lit("the")) | F.contains(low, F.lit("de"))).alias("has_term"), F.contains(text, plain).alias("inside"), (F.length(plain) <= G.SNIPPET).alias("short"))
