"""Digests, commits, projections, backfills and the relational export, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import commits as C
from parley.operators import digests as D
from parley.operators import items as I
from parley.operators import star_export as X
from parley.operators.storage import Work, parts_of, settled, setting, shared_path
from parley.plans.tables import MODELS, events, query, table

# ------------------------------------------------------------------ digest trees


def _tree_sql(rows: str, levels: int = 4, by: str = "") -> str:
    """Levels of a digest tree over ``rows``(rank, digest), by ``by`` with a comma after it, as common table expressions and their union."""
    part = f"partition by {by.rstrip(', ')}" if by else ""
    out = [f"l1 as (select {by}rank // {D.FANOUT} as node, count(*) as n_rows, sha256(string_agg(digest, '' order by rank)) as digest from {rows} group by {by}rank // {D.FANOUT})"]
    for k in range(2, levels + 1):
        more = f"{by.rstrip(', ')} in (select {by.rstrip(', ')} from l{k - 1} where node > 0)" if by else f"(select max(node) from l{k - 1}) > 0"
        out.append(f"l{k} as (select {by}node // {D.FANOUT} as node, sum(n_rows) as n_rows, sha256(string_agg(digest, '' order by node)) as digest from l{k - 1} where {more} group by {by}node // {D.FANOUT})")
    out.append("levels as (" + " union all ".join(f"select {by}{k} as level, node, cast(n_rows as bigint) as n_rows, digest from l{k}" for k in range(1, levels + 1)) + ")")
    return ", ".join(out) + (f", top as (select *, row_number() over ({part} order by level desc) as nth from levels)" if by else "")


_LINE = "sha256(concat(length(cast(doc_id as varchar)), ':', doc_id, case when text is null then 'N;' else concat('S', length(text), ':', text, ';') end))"


@query("snk_09_payload_digests", f"with p as (select row_number() over (order by doc_id) - 1 as rank, {_LINE} as digest from documents), {_tree_sql('p')} select level, node, n_rows, digest from levels")
def snk_09(spark, d):
    """Texts are written in the order of ids and read back; the tree is that of the files, and equals that of the rows."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return D.write_verified(docs, shared_path(spark, "payloads"), "doc_id", "text")


@query("agg_24_corpus_fingerprint", f"with p as (select lang, row_number() over (partition by lang order by doc_id) - 1 as rank, {_LINE} as digest from documents), {_tree_sql('p', by='lang, ')} select lang, n_rows, digest as fingerprint from top where nth = 1")
def agg_24(spark, d):
    """A language's documents in order, as the root of their digest tree: no task sees more than a run of them."""
    rows = table(spark, d, "documents").select("lang", "doc_id", D.payload("doc_id", "text").alias("digest"))
    return D.roots(D.tree(D.in_order(rows, ["doc_id"], ["lang"]), by=["lang"]), ["lang"]).withColumnRenamed("digest", "fingerprint")


# ------------------------------------------------------------------ commits

_BODIES = "select doc_id as dialogue, text as body, 1 as nth from documents union all select doc_id, concat(text, ' +'), 2 from documents where doc_id % 3 = 0 union all select doc_id, text, 3 from documents where doc_id % 9 = 0"


@query("snk_02_revision_write", f"""with b as ({_BODIES}), h as (select *, sha256(coalesce('S' || body, 'N')) as content_hash from b), r as (select *, 'rev_' || substr(sha256(concat_ws(chr(0), dialogue, 'p1', content_hash)), 1, 24) as revision from h),
 l as (select dialogue, max(nth) as nth from r group by dialogue), c as (select r.dialogue, r.revision from r join l on r.dialogue = l.dialogue and r.nth = l.nth)
 select distinct r.dialogue, r.revision, r.content_hash, c.revision is not null as is_current, length(r.body) as n_chars from r left join c on r.dialogue = c.dialogue and r.revision = c.revision""")
def snk_02(spark, d):
    """Three batches of revisions: all documents, a third of them changed, a ninth changed back; the second batch is sent twice."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("dialogue"), F.lit("p1").alias("parser"), F.col("text").alias("body"))
    t = C.revision_table(spark, shared_path(spark, "revisions"))
    changed = docs.filter("dialogue % 3 = 0").withColumn("body", F.concat("body", F.lit(" +")))
    C.write_revisions(t, docs, "all")
    C.write_revisions(t, changed, "changed")
    C.write_revisions(t, changed, "changed")
    t.vacuum()
    C.write_revisions(t, docs.filter("dialogue % 9 = 0"), "back")
    t.vacuum()
    return t.read().select("dialogue", "revision", "content_hash", "is_current", F.length("body").cast("bigint").alias("n_chars"))


@query("snk_04_projection_replace", """select conv_id as revision, turn, md5(text) as digest from conversations where conv_id % 4 <> 0 and conv_id % 10 <> 1
 union all select conv_id, turn, md5(concat('again ', text)) from conversations where conv_id % 4 = 0 and conv_id % 10 <> 1 and role <> 'system'""")
def snk_04(spark, d):
    """A projection of all dialogues, then of a fourth of them anew, while a tenth loses its rows."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("revision"), "turn", "role", "text")
    path = shared_path(spark, "projection")
    first = c.select("revision", "turn", F.md5("text").alias("digest"))
    C.replace_projection(spark, path, first, first.select("revision"))
    again = c.filter("revision % 4 = 0 and role <> 'system'").select("revision", "turn", F.md5(F.concat(F.lit("again "), "text")).alias("digest"))
    C.replace_projection(spark, path, again, c.filter("revision % 4 = 0").select("revision"))
    C.replace_projection(spark, path, again.limit(0), c.filter("revision % 10 = 1").select("revision"))
    return spark.read.parquet(path).select("revision", "turn", "digest")


@query("bkf_01_backfill", """with g as (select event_id, user_id, epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) as gap_ms from events)
 select event_id, gap_ms, 2 as operator_version, 2 as commits from g""")
def bkf_01(spark, d):
    """Gaps of stored events, computed anew where an older version of the operator had written them; the second run finds none."""
    e = events(spark, d).select("event_id", "user_id", "ms")

    def gaps(rows):
        gap = F.col("ms") - F.lag("ms").over(W.partitionBy("user_id").orderBy("ms", "event_id"))
        return rows.withColumn("gap_ms", gap)

    done = gaps(e).withColumn("operator_version", F.when(F.col("user_id") % 2 == 0, 2).otherwise(1))
    stored = done.withColumn("gap_ms", F.when(F.col("operator_version") == 2, F.col("gap_ms")))
    t = C.CommitTable(spark, shared_path(spark, "backfill"), ["event_id", "user_id"], bucket_by=["user_id"])
    t.merge(stored, "stored")
    for _ in range(2):
        C.backfill(t, gaps, ["user_id"], "operator_version", 2)
    return t.read().select("event_id", "gap_ms", "operator_version", F.lit(len(t.versions())).alias("commits"))


# ------------------------------------------------------------------ items and the export

HARNESSES = ("codex", "claude-code", "claude-desktop", "opencode", "cursor", "qwen-code", "kimi-code", "omp")
_user = "(l_linenumber = 1 or (l_linenumber = 2 and l_partkey % 5 = 0))"
_system = "(l_returnflag = 'R' and l_partkey % 3 = 0)"
_assistant = f"(not {_user} and not {_system})"
_harness = " ".join(f"when {i} then '{h}'" for i, h in enumerate(HARNESSES))
_named = " ".join(f"when {i} then '{m}'" for i, m in enumerate(MODELS))
#: Lines of an order may share their number, so messages are numbered anew.
_NTH = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)"
#: Line items as a harness reports messages: (column, expression in both dialects).
ITEM_MESSAGES = {
    "revision_id": "o_custkey", "message_id": "l_orderkey * 1000 + nth", "sequence": "l_orderkey * 1000 + nth",
    "harness": f"case o_custkey % {len(HARNESSES)} {_harness} end",
    "role": f"case when {_user} then 'user' when {_system} then 'system' else 'assistant' end",
    "raw_role": "case when l_partkey % 37 = 0 then 'compacted' end",
    "human": "case when l_linestatus = 'F' then true when l_partkey % 3 = 0 then false end",
    "visible": "case when l_partkey % 4 = 0 then false when l_partkey % 4 > 1 then true end",
    "is_meta": "l_suppkey % 29 = 0", "origin_kind": "case when l_partkey % 23 = 0 then 'task' when l_partkey % 23 = 1 then 'human' end",
    "typed_text": f"case when {_user} and l_partkey % 3 = 1 then concat('ask ', cast(l_partkey as string)) end",
    "side": "l_suppkey % 31 = 0", "phase": "case when l_linenumber >= 4 and l_partkey % 2 = 0 then 'final_answer' end",
    "finish": "case when l_partkey % 3 = 0 then 'stop' end", "turn_result": "l_partkey % 5 = 1",
    "usage": f"""case when {_assistant} and l_suppkey % 7 <> 0 then concat('{{"inputTokens":', cast(cast(floor(l_extendedprice * 5) as bigint) as string), ',"note":"x","outputTokens":', cast(cast(floor(l_quantity) as bigint) as string), '}}') when {_assistant} then '{{"x":1.5}}' end""",
    "kind0": f"case when not {_assistant} then 'text' else case l_suppkey % 6 when 0 then 'tool_call' when 1 then 'tool_result' when 2 then 'thought' when 3 then case when l_partkey % 2 = 0 then 'object' else 'text' end else 'text' end end",
    "content0": f"case when l_partkey % 53 = 0 then null when {_user} and l_partkey % 3 = 1 then concat('ctx ask ', cast(l_partkey as string), ' end') when {_user} then concat('say ', cast(l_partkey as string)) when l_partkey % 19 = 0 then '  ' else concat('answer ', cast(l_partkey as string)) end",
    "call0": "case when l_partkey % 11 <> 0 then cast(l_orderkey as string) end", "has1": "l_partkey % 4 = 0", "auto1": "l_partkey % 8 = 0", "content1": "concat('more ', cast(l_suppkey as string))",
    "model": f"case when {_assistant} and l_suppkey % 13 <> 0 then case l_suppkey % {len(MODELS)} {_named} end end",
    "parent": "case when o_custkey % 5 = 0 then cast(o_custkey - 1 as string) when o_custkey % 7 = 0 then 'elsewhere' end",
}
_FACTS = "select " + ", ".join(f"{e.replace('as string)', 'as varchar)')} as {c}" for c, e in ITEM_MESSAGES.items()) + f" from (select *, {_NTH} as nth from lineitem) join orders on l_orderkey = o_orderkey"
#: The item rules, told once more in SQL.
_ITEMS = f"""m as ({_FACTS}),
 c as (select message_id, 0 as seq, kind0 as kind, content0 as content, false as auto, call0 as call from m union all select message_id, 1, 'text', content1, auto1, null from m where has1),
 r as (select m.*, c.seq, c.kind, c.content, c.auto, c.call, message_id || ':' || c.seq as chunk_id,
  (role = 'system' or (kind not in ('tool_call', 'tool_result') and (raw_role is not distinct from 'compacted' or is_meta or (auto and typed_text is distinct from content) or (role = 'user' and (coalesce(origin_kind <> 'human', false) or side))))) as injected
  from c join m using (message_id)),
 s as (select distinct message_id from r where role = 'user' and kind = 'text' and not injected),
 t as (select m.*, sum((s.message_id is not null)::int) over (partition by revision_id order by sequence) as turn from m left join s on m.message_id = s.message_id),
 q as (select r.*, t.turn from r join t on r.message_id = t.message_id),
 g as (select message_id, revision_id, harness, typed_text, role = 'user' and (coalesce(human, false) or origin_kind is not distinct from 'human' or (harness = 'codex' and typed_text is not null)) as sure, string_agg(coalesce(content, ''), chr(10) order by seq) as original,
  coalesce(string_agg(content, chr(10) order by seq) filter (where not auto and length(content) > 0), '') as said, min(seq) as seq, list(chunk_id order by seq) as src from q where role = 'user' and kind = 'text' and not injected group by all),
 p as (select *, harness = 'codex' and typed_text is not null as typed from g),
 prompt as (select message_id, revision_id, seq, 'human_input' as category, sure, case when sure then 'human_structural_evidence' else 'legacy_ambiguous_authorship' end as reason,
  case when typed then 'codex_user_message_event' when trim(said) = '' then 'canonical_text_chunks' when sure then replace(harness, '-', '_') || '_human_text_chunks' else 'fallback_visible_user_text' end as method, case when typed then typed_text when trim(said) = '' then original else said end as content, src from p),
 remainder as (select message_id, revision_id, seq, 'instructions' as category, true as sure, 'codex_confirmed_input_remainder' as reason, 'codex_user_message_event_difference' as method, replace(original, typed_text, '') as content, src from p where typed and length(original) - length(replace(original, typed_text, '')) = length(typed_text) and original <> typed_text),
 able as (select message_id, turn, revision_id, sequence, harness, visible, phase = 'final_answer' and harness = 'codex' as marked, (harness = 'opencode' and finish is not distinct from 'stop') or (harness = 'claude-desktop' and turn_result) as ended from t
  where role = 'assistant' and not (visible is not distinct from false and side) and not (harness in ('claude-code', 'claude-desktop', 'kimi-code') and side) and (harness not in ('omp', 'qwen-code') or coalesce(visible, false))),
 marks as (select revision_id, turn, max(case when marked then sequence end) as mark, bool_or(ended) as ended from able group by all),
 said as (select a.message_id, a.turn, a.revision_id, a.sequence, a.harness, a.visible, min(q.seq) as seq, string_agg(q.content, chr(10) order by q.seq) as content, list(q.chunk_id order by q.seq) as src from able a join q on a.message_id = q.message_id
  where q.kind = 'text' and not q.injected and length(q.content) > 0 group by all having trim(string_agg(q.content, chr(10) order by q.seq)) <> ''),
 ends as (select said.*, mark, ended, max(sequence) over (partition by revision_id, turn) as last, coalesce(max(case when sequence = mark then 1 else 0 end) over (partition by revision_id, turn), 0) = 1 as has_mark from said join marks using (revision_id, turn)),
 f as (select revision_id, turn, harness, arg_min(message_id, sequence) as message_id, arg_min(seq, sequence) as seq, string_agg(content, chr(10) order by sequence) as content, flatten(list(src order by sequence)) as src, bool_and(coalesce(visible, false)) as seen,
  case harness when 'codex' then bool_or(has_mark) else bool_or(ended) end as done from ends where harness <> 'codex' or sequence = case when has_mark then mark else last end group by revision_id, turn, harness),
 final as (select message_id, revision_id, seq, case when seen and not done then 'assistant_other' else 'assistant_final' end as category, seen as sure, case when seen and done then 'harness_final_evidence' when seen then 'visible_assistant_text_fallback' else 'ambiguous_final_or_visibility' end as reason,
  case when not done then 'fallback_visible_assistant_text' when harness = 'codex' then 'codex_final_answer_phase' when harness = 'opencode' then 'opencode_finish_stop_text' else 'claude_desktop_turn_result' end as method, content, src from f),
 part as (select message_id, revision_id, seq, case when injected then 'instructions' when kind = 'text' then case when role = 'assistant' then 'assistant_other' else 'unknown' end else kind end as category,
  injected or (kind = 'text' and role = 'assistant' and coalesce(visible, false)) or kind in ('thought', 'tool_call', 'tool_result') as sure,
  case when injected then 'structural_instruction' when kind = 'text' and role = 'assistant' then case when coalesce(visible, false) then 'visible_assistant_text' else 'legacy_ambiguous_visibility' end when kind in ('thought', 'tool_call', 'tool_result') then 'canonical_kind' else 'unclassified_canonical_kind' end as reason,
  'canonical_chunk' as method, content, [chunk_id] as src from q where injected or (not (role = 'user' and kind = 'text') and not (kind = 'text' and chunk_id in (select unnest(src) from final)))),
 used as (select message_id, revision_id, null as seq, 'usage' as category, true as sure, 'normalized_usage_allowlist' as reason, 'normalized_usage' as method, replace(usage, '"note":"x",', '') as content, [] as src from m where usage like '%inputTokens%'),
 items as (select *, case when category = 'instructions' then 'instructions' when sure then 'main' else 'review' end as layer, message_id || ':' || category || ':' || coalesce(seq::varchar, 'derived') as id from (select * from prompt union all select * from remainder union all select * from final union all select * from part union all select * from used))"""


def _facts(spark, d, parts=None):
    """Messages of line items; with ``parts``, dealt out to so many by the revision, as lines, which are shorter."""
    lines, orders = table(spark, d, "lineitem").withColumn("nth", F.expr(_NTH)), table(spark, d, "orders")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    ts = F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, l_linenumber * 97)").alias("timestamp")
    return (rows.repartition(parts, "o_custkey") if parts else rows).select(*(F.expr(e).alias(c) for c, e in ITEM_MESSAGES.items()), ts)


def _chunks(facts):
    """One chunk a message, and a second of some."""
    none = F.lit(None).cast("string")
    chunk = lambda n, kind, content, auto, call: F.struct(F.lit(n).cast("bigint").alias("chunk_sequence"), kind.alias("kind"), content.alias("content"), auto.alias("auto_context"), call.alias("tool_call_id"))
    first = chunk(0, F.col("kind0"), F.col("content0"), F.lit(False), F.col("call0"))
    second = chunk(1, F.lit("text"), F.col("content1"), F.col("auto1"), none)
    both = facts.select("revision_id", "message_id", F.explode(F.when(F.col("has1"), F.array(first, second)).otherwise(F.array(first))).alias("chunk")).select("revision_id", "message_id", "chunk.*")
    tool = F.when(F.col("kind").isin("tool_call", "tool_result"), F.lit("shell"))
    return both.withColumns({"chunk_id": F.concat_ws(":", F.col("message_id").cast("string"), F.col("chunk_sequence").cast("string")), "tool_name": tool, "raw_kind": none, "source_locator": F.concat(F.lit("line:"), F.col("message_id").cast("string"))})


@query("seg_07_projected_items", f"""with {_ITEMS} select category, layer, sure, reason, method, count(*) as n, count(distinct id) as n_ids, cast(coalesce(sum(length(content)), 0) as bigint) as chars, cast(sum(len(src)) as bigint) as sources from items group by all""")
def seg_07_projected(spark, d):
    """Every reason that the rules know, over messages of all eight harnesses."""
    facts = settled(_facts(spark, d).drop("model", "parent", "timestamp"), "facts")  # messages and both kinds of chunks are made of these
    items = I.project_items(facts, _chunks(facts), "separate")
    g = items.groupBy("category", "layer", (F.col("classification") == "confirmed").alias("sure"), "reason", F.col("extraction_method").alias("method"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("n_ids"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"), F.sum(F.size("source_chunks")).alias("sources"))


def _manifest(facts):
    """A revision a customer, with the counts that the export is held to."""
    n = facts.groupBy("revision_id", "harness", "parent").agg(F.count(F.lit(1)).alias("message_count"), (F.count(F.lit(1)) + F.count_if("has1")).alias("chunk_count"))
    none = F.lit(None).cast("string")
    return n.select(
        "revision_id", F.col("revision_id").alias("dialogue_id"), none.alias("source_revision"), F.sha2(F.col("revision_id").cast("string"), 256).alias("canonical_hash"), "message_count", "chunk_count", F.lit(True).alias("is_current"), "harness",
        F.col("harness").alias("installation"), F.concat(F.lit("host"), (F.col("revision_id") % 7).cast("string")).alias("host"), none.alias("host_label"), F.lit("linux").alias("platform"), none.alias("arch"), none.alias("workspace"), none.alias("title"),
        F.lit("p1").alias("parser_name"), F.lit("1").alias("parser_version"), F.col("revision_id").cast("string").alias("source_dialogue"), F.col("parent").alias("parent_dialogue"),
    )


def export_path(spark, d) -> str:
    """Exports the canonical facts of the tables and gives the folder."""
    path = shared_path(spark, "export")
    model = {"vendor": F.split("model", "/")[0], "service_provider": F.split("model", "/")[0], "reasoning_effort": F.lit(None).cast("string"), "response_status": F.lit("completed")}
    with Work(spark, parts_of(spark, table(spark, d, "lineitem").count())) as work, setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        facts = work.placed(_facts(spark, d, work.parts), "facts", "revision_id")
        X.export(_manifest(facts), facts.withColumns(model | {"model": F.split("model", "/")[1]}), _chunks(facts), path, "separate", fixed=lambda: work.drop("facts"))
    return path


_EXPORT = f"""with {_ITEMS}, src as (select id, unnest(src) as chunk_id from items), owners as (select message_id from items union select cast(split_part(chunk_id, ':', 1) as bigint) from src), calls as (select i.id, i.category, r.call, i.revision_id from items i join r on i.src[1] = r.chunk_id where i.category in ('tool_call', 'tool_result')),
 pairs as (select revision_id, call, count(*) filter (where category = 'tool_call') as a, count(*) filter (where category = 'tool_result') as b from calls where call is not null group by all), revs as (select distinct revision_id, parent, harness from m where revision_id in (select revision_id from items)), models as (select distinct model from m where model is not null and message_id in (select message_id from owners))"""


@query("snk_06_star_export", _EXPORT + """ select 'corpus_manifest' as relation, count(distinct revision_id) as n from m union all select 'hosts', count(distinct revision_id % 7) from revs union all select 'models', count(*) from models union all select 'dialogues', count(*) from revs union all select 'dialogue_revisions', count(*) from revs
 union all select 'messages', count(*) from owners union all select 'chunks', count(distinct chunk_id) from src union all select 'items', count(*) from items union all select 'item_sources', count(*) from src union all select 'analysis_items', count(*) from items where layer = 'main' union all select 'instructions', count(*) from items where layer = 'instructions'
 union all select 'instruction_applications', count(*) from items where layer = 'instructions' union all select 'review_items', count(*) from items where layer = 'review' union all select 'export_info', 6 union all select 'data_dictionary', 16
 union all select 'relations', (select count(*) from revs where parent is not null) + (select count(*) from calls left join pairs using (revision_id, call) where not coalesce(a = 1 and b = 1 and category = 'tool_result', false))""")
def snk_06(spark, d):
    """Rows of the sixteen relations; keys and texts are checked by the export itself."""
    names = X.open_export(spark, export_path(spark, d), "snk_06_")
    out = None
    for r in X.RELATIONS:
        n = spark.table(names[r]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("relation"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("join_06_export_view", _EXPORT + """, n as (select id, count(distinct split_part(chunk_id, ':', 1)) as n from src group by id) select m.harness, i.category, case when coalesce(n, 1) = 1 then 'single_source' else 'multiple_sources_see_item_sources' end as attribution_status,
 case when coalesce(n, 1) = 1 then split_part(m.model, '/', 2) end as model, count(*) as items, cast(coalesce(sum(length(i.content)), 0) as bigint) as chars from items i join m on i.message_id = m.message_id left join n on n.id = i.id where i.layer = 'main' group by all""")
def join_06_view(spark, d):
    """The analysis view over the export's files: items and messages are bucketed by what they are joined on."""
    names = X.open_export(spark, export_path(spark, d), "join_06_")
    g = spark.table(names["v_analysis_messages"]).groupBy("harness", "category", "attribution_status", "model")
    # With more partitions than buckets, Spark would move what is bucketed already.
    with setting(spark, "spark.sql.shuffle.partitions", str(X.BUCKETS)), setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return settled(g.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars")), "view")


@query("rel_01_export_relations", _EXPORT + """, st as (select case when a = 1 and b = 1 then 'confirmed' when a > 1 or b > 1 then 'ambiguous' else 'unpaired' end as status, a = 1 and b = 1 and category = 'tool_result' as second from calls left join pairs using (revision_id, call)),
 ids as (select distinct harness, cast(revision_id as varchar) as own from revs), par as (select case when i.own is not null then 'confirmed' else 'outside_export' end as status from revs r left join ids i on i.own = r.parent and i.harness = r.harness where r.parent is not null)
 select 'tool_call_result' as kind, status, count(*) as n from st where not coalesce(second, false) group by all union all select 'parent', status, count(*) from par group by all""")
def rel_01(spark, d):
    """Calls with results and revisions with parents, as the export has them; ids are the places in its files."""
    names = X.open_export(spark, export_path(spark, d), "rel_01_")
    rows = spark.table(names["relations"])
    return rows.groupBy("kind", "status").agg(F.countDistinct("id").alias("n"))
