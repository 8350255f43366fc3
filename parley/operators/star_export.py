"""The relational export: sixteen relations as Parquet tables, views over them, and the checks that must hold before it is used.

Identities are aliases under a key of the export, so any task can name a row and no join is needed for it; the key isn't kept.
Only ``relations`` has numbers for ids: they are places in its files, counted by file and row, not sorted.  Facts that are
joined with each other are bucketed by the id that they are joined on, and ``open_export`` registers them so.
"""

from __future__ import annotations

import json
import secrets
import uuid
from collections.abc import Callable
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.documents import alias
from parley.operators.digests import payload, set_digests
from parley.operators.items import project_items, tool_relations
from parley.operators.storage import Files, Work, numbered, parts_of, setting

FORMAT, VERSION = "conversation-export", 1
BUCKETS = 48
#: Aliases are hexadecimal digits, which take half their room with entropy coding.
CODEC = "zstd"
#: Relation -> the column that its files are bucketed by.
BUCKETED = {"messages": "id", "chunks": "id", "items": "id", "item_sources": "item_id", "analysis_items": "item_id", "instructions": "id", "instruction_applications": "item_id", "review_items": "item_id"}
#: (relation, column, relation that it refers to, its column).
FOREIGN_KEYS = (
    ("dialogues", "host_id", "hosts", "id"), ("dialogue_revisions", "dialogue_id", "dialogues", "id"), ("messages", "revision_id", "dialogue_revisions", "id"), ("messages", "model_id", "models", "id"),
    ("chunks", "message_id", "messages", "id"), ("items", "message_id", "messages", "id"), ("item_sources", "item_id", "items", "id"), ("item_sources", "chunk_id", "chunks", "id"),
    ("analysis_items", "item_id", "items", "id"), ("instruction_applications", "item_id", "items", "id"), ("instruction_applications", "instruction_id", "instructions", "id"),
    ("instruction_applications", "revision_id", "dialogue_revisions", "id"), ("instruction_applications", "message_id", "messages", "id"), ("review_items", "item_id", "items", "id"),
    ("relations", "from_item", "items", "id"), ("relations", "to_item", "items", "id"), ("relations", "from_revision", "dialogue_revisions", "id"), ("relations", "to_revision", "dialogue_revisions", "id"),
)
#: Relations whose ids must be unique.
KEYS = {"corpus_manifest": "revision_ref", "hosts": "id", "models": "id", "dialogues": "id", "dialogue_revisions": "id", "messages": "id", "chunks": "id", "items": "id", "analysis_items": "item_id", "instructions": "id", "instruction_applications": "item_id", "review_items": "item_id", "relations": "id"}
#: The relations of KEYS whose ids and references are audited together: one shuffle at a time.
AUDITED = (("items",), ("analysis_items", "instructions", "instruction_applications", "review_items"), ("messages",), ("chunks",), ("corpus_manifest", "hosts", "models", "dialogues", "dialogue_revisions", "relations"))
#: Relations with text, whose files are read back and compared with what was to be written: id and text.
PAYLOADS = {"chunks": ("id", "content"), "analysis_items": ("item_id", "content"), "instructions": ("id", "content"), "review_items": ("item_id", "content")}
DESCRIPTIONS = {
    "corpus_manifest": "The revisions that the export was fixed to before any text was read, with or without selected content.",
    "hosts": "Where transcripts were found.", "models": "Models that messages name.", "dialogues": "Dialogues with selected content.",
    "dialogue_revisions": "Revisions of these dialogues; parent references are aliases too.", "messages": "Messages that own a selected part. human_authored and visible_to_user are true, false or unknown.",
    "chunks": "Selected parts of messages; content only where a part is an item of the main layer by itself.", "items": "Every selected part with its category, layer and reason.",
    "item_sources": "The chunks that an item consists of.", "analysis_items": "Text of the main layer.", "instructions": "Text that a harness put in.", "instruction_applications": "Where an instruction was seen.",
    "review_items": "What has no evidence, if it is to be reviewed.", "relations": "Calls with their results, and revisions with their parents.", "export_info": "Format, settings, counts and digests.",
    "data_dictionary": "This table.",
}
RELATIONS = (*KEYS, "item_sources", "export_info", "data_dictionary")

VIEWS = {
    # An item of one source has one message (the audit found its chunk); only the sources of others meet chunks.
    "v_item_source_counts": """with own as (select item_id, count(*) as sources from {item_sources} group by item_id), more as (select item_id from own where sources > 1),
 met as (select s.item_id, count(distinct c.message_id) as messages from more join {item_sources} s on s.item_id = more.item_id join {chunks} c on c.id = s.chunk_id group by s.item_id)
 select own.item_id, coalesce(met.messages, 1) as source_message_count from own left join met on met.item_id = own.item_id""",
    "v_analysis_messages": """select d.id as dialogue_id, r.id as revision_id, i.id as item_id, m.id as message_id, m.sequence, i.chunk_sequence, i.role, i.category, a.content, m.timestamp, d.harness, d.host_id,
 case when coalesce(n.source_message_count, 1) = 1 then o.canonical_name end as model, case when coalesce(n.source_message_count, 1) = 1 then o.vendor end as vendor,
 case when coalesce(n.source_message_count, 1) = 1 then m.service_provider end as service_provider, case when coalesce(n.source_message_count, 1) = 1 then m.reasoning_effort end as reasoning_effort,
 m.response_status, i.classification, i.reason, i.extraction_method, i.turn_id, i.context_included, coalesce(n.source_message_count, 1) as source_message_count,
 case when coalesce(n.source_message_count, 1) = 1 then 'single_source' else 'multiple_sources_see_item_sources' end as attribution_status
 from {analysis_items} a join {items} i on i.id = a.item_id left join {v_item_source_counts} n on n.item_id = i.id join {messages} m on m.id = i.message_id
 join {dialogue_revisions} r on r.id = m.revision_id join {dialogues} d on d.id = r.dialogue_id left join {models} o on o.id = m.model_id""",
    "v_qa": "select * from {v_analysis_messages} where category in ('human_input', 'assistant_final')",
}


class ExportError(ValueError):
    """The export isn't what it should be, and isn't to be used."""


def _text(flag: Column) -> Column:
    return F.when(flag.isNull(), "unknown").otherwise(flag.cast("string"))


class Names:
    """Aliases of one export."""

    def __init__(self, key: str):
        self.key = key

    def __call__(self, kind: str, *parts: Column) -> Column:
        value = parts[0].cast("string") if len(parts) == 1 else F.concat_ws("\x00", *(p.cast("string") for p in parts))
        missing = parts[0].isNull()
        return F.when(~missing, alias(F.concat(F.lit(f"{kind}\x00"), value), self.key, kind[:3]))


def relations_of(manifest: DataFrame, messages: DataFrame, chunks: DataFrame, items: DataFrame, name: Names, work: Work) -> dict[str, DataFrame]:
    """The fourteen relations of data, ``relations`` without its ids.  messages, chunks and items lie by the revision, so nothing of these is moved.

    manifest: revision_id, dialogue_id, source_revision, canonical_hash, message_count, chunk_count, is_current, harness,
    installation, host, host_label, platform, arch, workspace, title, parser_name, parser_version, source_dialogue,
    parent_dialogue.  messages and chunks as for ``project_items``, chunks with revision_id, messages also with timestamp, vendor, model,
    service_provider, reasoning_effort, response_status; chunks also with raw_kind and source_locator.
    """
    c = F.col
    used = items.select("revision_id").distinct()
    rows = work.settled(manifest.join(used, "revision_id"), "revisions")
    # What items say of a chunk meets the chunk once; an item that is one chunk by itself has the chunk's own text.
    alone = (c("layer") == "main") & (c("extraction_method") == "canonical_chunk") & (F.size("source_chunks") == 1)
    of = items.select("revision_id", F.explode("source_chunks").alias("chunk_id"), alone.alias("alone"), c("category").isin("tool_call", "tool_result").alias("is_tool"))
    of = of.groupBy("revision_id", "chunk_id").agg(F.bool_or("alone").alias("alone"), F.bool_or("is_tool").alias("is_tool"))
    kept = chunks.select("chunk_id", "revision_id", "message_id", "chunk_sequence", "kind", "raw_kind", "source_locator", "tool_call_id", "tool_name", "content").join(of, ["revision_id", "chunk_id"])
    kept = work.placed(kept.withColumn("direct", F.when(c("alone"), c("content"))).drop("content", "alone"), "kept", "revision_id")
    # A message is exported if an item names it or one of its chunks is a source.
    by = ["revision_id", "message_id"]
    owners = [x.select(*by).distinct().withColumn(flag, F.lit(True)) for flag, x in (("_item", items), ("_source", kept))]
    observed = items.filter("layer = 'instructions'").select("revision_id").distinct().withColumn("seen", F.lit(True))
    model = F.when(c("model").isNotNull(), name("model", F.coalesce("vendor", F.lit("")), c("model")))
    sent = messages.select("revision_id", "message_id", "sequence", "role", "raw_role", "timestamp", "vendor", "model", "service_provider", "reasoning_effort", "response_status", "human", "visible")
    sent = sent.join(owners[0], by, "left").join(owners[1], by, "left").filter("_item or _source").drop("_item", "_source")
    sent = work.placed(sent, "sent", "revision_id")
    locator = F.when(c("source_locator").rlike(r"^(line:\d+|index:\d+|L\d+|\d+)$"), c("source_locator"))
    item, message, revision = name("item", c("item_id")), name("message", c("message_id")), name("revision", c("revision_id"))
    source = lambda x: F.when(c(x).isNotNull(), name("source", c("installation"), c(x)))
    out = {
        "corpus_manifest": manifest.select(revision.alias("revision_ref"), name("dialogue", c("dialogue_id")).alias("dialogue_ref"), name("source_revision", c("source_revision")).alias("source_revision_ref"), "canonical_hash", "message_count", "chunk_count", c("is_current").cast("int").alias("is_current")),
        "hosts": rows.select(name("host", c("host")).alias("id"), c("host_label").alias("label"), "platform", "arch").dropDuplicates(["id"]),
        "models": sent.filter(c("model").isNotNull()).select("vendor", "model").distinct().select(model.alias("id"), "vendor", c("model").alias("canonical_name")).dropDuplicates(["id"]),
        "dialogues": rows.select(name("dialogue", c("dialogue_id")).alias("id"), "harness", name("installation", c("installation")).alias("harness_installation"), name("host", c("host")).alias("host_id"), name("workspace", c("workspace")).alias("workspace_id"), "title").dropDuplicates(["id"]),
        "dialogue_revisions": rows.join(observed, "revision_id", "left").select(
            revision.alias("id"), name("dialogue", c("dialogue_id")).alias("dialogue_id"), name("source_revision", c("source_revision")).alias("source_revision"), "parser_name", "parser_version", "canonical_hash", c("is_current").cast("int").alias("is_current"),
            source("source_dialogue").alias("source_dialogue_ref"), source("parent_dialogue").alias("parent_source_dialogue_ref"), F.when(c("seen"), "observed").otherwise("not_observed").alias("instructions_status")),
        "messages": sent.select(
            message.alias("id"), revision.alias("revision_id"), "sequence", "role", "raw_role", "timestamp", model.alias("model_id"), "service_provider", "reasoning_effort", "response_status",
            _text(c("human")).alias("human_authored"), _text(c("visible")).alias("visible_to_user"), F.lit(0).alias("context_included")),
        "chunks": kept.select(
            name("chunk", c("chunk_id")).alias("id"), message.alias("message_id"), c("chunk_sequence").alias("sequence"), "kind", "raw_kind", locator.alias("source_locator"),
            F.when(c("is_tool") & c("tool_call_id").isNotNull(), name("call", c("revision_id"), c("tool_call_id"))).alias("tool_call_id"), F.when(c("is_tool"), c("tool_name")).alias("tool_name"), c("direct").alias("content")),
        "items": items.select(
            item.alias("id"), message.alias("message_id"), "sequence", "chunk_sequence", "role", "kind", "category", "origin", "layer", "classification", "reason", "extraction_method", name("turn", c("turn_id")).alias("turn_id"),
            F.lit(1).alias("matched"), F.lit(0).alias("context_included")),
        "item_sources": items.select(item.alias("item_id"), F.explode("source_chunks").alias("chunk")).select("item_id", name("chunk", c("chunk")).alias("chunk_id")),
        "analysis_items": items.filter("layer = 'main'").select(item.alias("item_id"), "content"),
        "instructions": items.filter("layer = 'instructions'").select(item.alias("id"), "kind", "content", F.lit("historically_observed").alias("observation_status")),
        "instruction_applications": items.filter("layer = 'instructions'").select(item.alias("item_id"), item.alias("instruction_id"), revision.alias("revision_id"), message.alias("message_id"), F.lit("observed_message_context").alias("scope")),
        "review_items": items.filter("layer in ('review', 'metadata')").select(item.alias("item_id"), "reason", "content"),
    }
    calls = tool_relations(items).select("kind", name("item", c("from_item")).alias("from_item"), name("item", c("to_item")).alias("to_item"), F.lit(None).cast("string").alias("from_revision"), F.lit(None).cast("string").alias("to_revision"), F.lit(None).cast("string").alias("external_ref"), "status")
    own = out["dialogue_revisions"]
    known = own.groupBy(c("source_dialogue_ref").alias("ref")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("parent"))
    child = own.filter("parent_source_dialogue_ref is not null").join(known, c("parent_source_dialogue_ref") == c("ref"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(c("n") == 1, "confirmed").when(c("n") > 1, "ambiguous").otherwise("outside_export")
    parents = child.select(F.lit("parent").alias("kind"), F.lit(None).cast("string").alias("from_item"), F.lit(None).cast("string").alias("to_item"), c("id").alias("from_revision"), F.when(c("n") == 1, c("parent")).alias("to_revision"), F.when(c("n") != 1, c("parent_source_dialogue_ref")).alias("external_ref"), status.alias("status"))
    return out | {"relations": calls.unionByName(parents)}


def _write(rows: DataFrame, path: str, bucket: str | None) -> None:
    """Files of a relation; the bucketed ones in one pass, as a table that only this call knows."""
    if bucket is None:
        rows.write.option("compression", CODEC).parquet(path)
        return
    table = f"parley_export_{uuid.uuid4().hex}"
    # A task writes its own rows of each bucket, so none are moved, and what is alike in neighbouring rows stays together.
    rows.write.format("parquet").option("compression", CODEC).bucketBy(BUCKETS, bucket).option("path", path).saveAsTable(table)
    rows.sparkSession.sql(f"drop table {table}")  # external: files stay


def export(manifest: DataFrame, messages: DataFrame, chunks: DataFrame, path: str, unknown_policy: str = "include", key: str | None = None, fixed: Callable[[], None] | None = None) -> dict[str, int]:
    """Writes all relations under ``path``, checks them and gives their row counts; raises ``ExportError`` if a check fails.

    The counts of the manifest are fixed before texts are read and must be those found.  Texts are read back and compared by
    digests over ids and texts, NULL apart from ''.  ``export_info`` is written last: an export without it isn't whole.

    Rows are moved by the revision once, if they don't lie so already (chunks may name their message's revision); work tables and
    shuffles go as soon as they are read.  ``fixed`` is called when messages and chunks aren't read any more.
    """
    spark = manifest.sparkSession
    with ExitStack() as held:
        # The driver keeps a text of every plan, and these name each row by a digest.
        held.enter_context(setting(spark, "spark.sql.maxPlanStringLength", "8192"))
        # Else shuffle files stay until the driver happens to collect its garbage.
        held.enter_context(setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"))
        work = held.enter_context(Work(spark, parts_of(spark, messages.count())))
        # A writing task sorts its rows by bucket; so many stay in its memory.
        held.enter_context(setting(spark, "spark.sql.files.maxPartitionBytes", "32m"))
        # One partitioning, by the revision, does for joins, groups and windows.
        held.enter_context(setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"))
        held.enter_context(setting(spark, "spark.sql.shuffle.partitions", str(work.parts)))
        return _export(manifest, messages, chunks, path, unknown_policy, key, work, fixed)


def _export(manifest: DataFrame, messages: DataFrame, chunks: DataFrame, path: str, unknown_policy: str, key: str | None, work: Work, fixed: Callable[[], None] | None) -> dict[str, int]:
    spark = manifest.sparkSession
    placed = lambda rows, name: work.placed(rows, name, "revision_id")
    manifest = work.settled(manifest, "manifest")
    n, m, k = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("message_count"), F.lit(0)), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
    # What is exported is fixed here; every relation is made of these.
    messages = placed(messages.join(manifest.select("revision_id"), "revision_id", "left_semi"), "messages")
    by = ["revision_id", "message_id"] if "revision_id" in chunks.columns else ["message_id"]
    chunks = placed(chunks.join(messages.select("revision_id", "message_id"), by), "chunks")
    if (messages.count(), chunks.count()) != (m, k):
        raise ExportError("messages or chunks aren't those that the manifest counts")
    if fixed:
        fixed()
    items = placed(project_items(messages, chunks, unknown_policy, placed), "items")
    work.drop("turned")
    data = relations_of(manifest, messages, chunks, items, Names(key or secrets.token_hex(32)), work)
    work.drop("messages", "chunks")
    for name, rows in data.items():
        _write(rows, f"{path}/{name}", BUCKETED.get(name))
    # ``relations`` gets numbers by its places in the files.
    numbered(spark, f"{path}/relations", data["relations"].columns, "id").write.option("compression", CODEC).parquet(f"{path}/relations.numbered")
    files = Files(spark, path)
    files.fs.delete(files.path("relations"), True)
    files.fs.rename(files.path("relations.numbered"), files.path("relations"))
    digests = verified_payloads(spark, data, path)
    work.drop("items", "kept", "sent", "revisions", "manifest")
    spark.createDataFrame(sorted(DESCRIPTIONS.items()), "name string, description string").coalesce(1).write.parquet(f"{path}/data_dictionary")
    read = {name: spark.read.parquet(f"{path}/{name}") for name in RELATIONS if name != "export_info"}
    wrong = [r.asDict() for r in audit(read).filter("violations > 0").collect()]
    if wrong:
        raise ExportError(f"keys don't hold: {wrong}")
    counts = {name: rows.count() for name, rows in read.items()}
    info = {"format": FORMAT, "formatVersion": VERSION, "counts": counts | {"manifest_revisions": n, "manifest_messages": m, "manifest_chunks": k}, "payload_digests": digests, "config": {"unknownPolicy": unknown_policy}, "buckets": BUCKETS}
    spark.createDataFrame([(a, json.dumps(b)) for a, b in sorted(info.items())], "key string, value string").coalesce(1).write.parquet(f"{path}/export_info")
    return counts | {"export_info": len(info)}


def verified_payloads(spark: SparkSession, data: dict[str, DataFrame], path: str) -> dict[str, dict]:
    """Rows and digest of the texts of each relation that has some, from what was to be written and from the files, in one pass."""
    both = None
    for name, (id_, content) in PAYLOADS.items():
        for side, x in (("written", data[name]), ("read", spark.read.schema(data[name].schema).parquet(f"{path}/{name}"))):
            part = x.select(F.lit(side).alias("side"), F.lit(name).alias("relation"), payload(id_, content).alias("digest"))
            both = part if both is None else both.unionByName(part)
    found: dict[str, dict] = {name: {} for name in PAYLOADS}
    for r in set_digests(both, ["side", "relation"]).collect():  # two rows a relation
        found[r.relation][r.side] = {"rows": r.n_rows, "sha256": r.digest}
    for name, own in found.items():
        if own.get("written") != own.get("read"):
            raise ExportError(f"{path}/{name}: texts that were read back aren't those written")
    return {name: own.get("read", {"rows": 0, "sha256": None}) for name, own in found.items()}


def _packed(id_: Column) -> Column:
    """An id's bytes, of an alias those that its digits stand for: aliases take most of what the audit moves.  No two ids have the same."""
    hexed = F.concat(F.encode(F.substring(id_, 1, 4), "UTF-8"), F.unhex(F.substring(id_, 5, 16)))
    return F.when(id_.rlike("^[a-z]{3}_[0-9a-f]{16}$"), hexed).otherwise(F.concat(F.lit(bytes(1)), F.encode(id_, "UTF-8")))


def audit(read: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations): repeated ids, and ids that a reference names and no row has; a grouping of ids and references for each of ``AUDITED``.

    Each id comes with the rules that name it as a bit set, so ids and references are moved once and meet where they are counted.
    """
    at = {name: i for i, name in enumerate(KEYS)}
    row = lambda x, own, named: (_packed(F.col(x).cast("string")).alias("id"), F.lit(own).alias("own"), F.lit(named).cast("bigint").alias("named"))
    found: dict[str, int] = {}
    for names in AUDITED:
        ids = [read[name].select(F.lit(at[name]).alias("relation"), *row(KEYS[name], 1, 0)) for name in names]
        for i, (name, column, other, _) in enumerate(FOREIGN_KEYS):
            if other in names:
                ids.append(read[name].filter(F.col(column).isNotNull()).select(F.lit(at[other]).alias("relation"), *row(column, 0, 1 << i)))
        met = reduce(DataFrame.unionByName, ids).groupBy("relation", "id").agg(F.sum("own").alias("own"), F.bit_or("named").alias("named"))
        unique = F.array(*(F.when((F.col("relation") == at[name]) & (F.col("own") > 0), f"unique:{name}") for name in names))
        lost = F.array(*(F.when((F.col("own") == 0) & (F.col("named").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0), f"reference:{name}.{column}") for i, (name, column, _, _) in enumerate(FOREIGN_KEYS)))
        wrong = met.filter("own <> 1 or id is null").select(F.explode(F.concat(unique, lost)).alias("rule")).filter("rule is not null")
        found |= {r.rule: r.n for r in wrong.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a broken rule
    rules = [f"unique:{name}" for name in KEYS] + [f"reference:{name}.{column}" for name, column, _, _ in FOREIGN_KEYS]
    return next(iter(read.values())).sparkSession.createDataFrame([(r, found.get(r, 0)) for r in rules], "rule string, violations bigint")


def open_export(spark: SparkSession, path: str, prefix: str = "") -> dict[str, str]:
    """Registers an export's relations, bucketed as they were written, and its views; gives their names.

    Refuses what has no ``export_info`` or another format.
    """
    if not Files(spark, path).names("export_info"):
        raise ExportError(f"{path} isn't a whole export")
    info = {r.key: json.loads(r.value) for r in spark.read.parquet(f"{path}/export_info").collect()}
    if (info.get("format"), info.get("formatVersion")) != (FORMAT, VERSION):
        raise ExportError(f"{path} has format {info.get('format')} {info.get('formatVersion')}")
    names = {name: f"{prefix}{name}" for name in RELATIONS}
    for name, table in names.items():
        if (bucket := BUCKETED.get(name)) is None:
            spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(table)
            continue
        spark.sql(f"drop table if exists {table}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
        spark.sql(f"create table {table} ({columns}) using parquet clustered by ({bucket}) into {info['buckets']} buckets location '{path}/{name}'")
    for view, text in VIEWS.items():
        names[view] = f"{prefix}{view}"
        spark.sql(text.format(**names)).createOrReplaceTempView(names[view])
    return names
