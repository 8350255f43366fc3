"""The analytical export: pairings, lineage, usage folding and item classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.sequences import turns

SCOPES = ("request", "turn", "session_cumulative", "unknown")


def pair_calls(rows: DataFrame, keys: list[str], is_call: Column, is_result: Column) -> DataFrame:
    """Per key: calls, results and whether they pair one to one."""
    n = rows.groupBy(*keys).agg(F.count_if(is_call).alias("calls"), F.count_if(is_result).alias("results")).filter("calls + results > 0")
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    status = F.when(null_key | (F.col("calls") == 0) | (F.col("results") == 0), "unpaired").when((F.col("calls") == 1) & (F.col("results") == 1), "confirmed").otherwise("ambiguous")
    return n.withColumn("pairing", status)


def parent_status(rows: DataFrame, row_id: str, own: str, parent: str) -> DataFrame:
    """How many exported rows a row's parent key names: one, several or none."""
    n = rows.groupBy(F.col(own).alias("_k")).agg(F.count(F.lit(1)).alias("parents"))
    out = rows.filter(F.col(parent).isNotNull()).join(n, F.col(parent) == F.col("_k"), "left").withColumn("parents", F.coalesce("parents", F.lit(0)))
    status = F.when(F.col("parents") == 0, "outside_export").when(F.col("parents") == 1, "confirmed").otherwise("ambiguous")
    return out.select(F.col(row_id).alias("id"), status.alias("status"), "parents")


def normalize_usage(events: DataFrame, key: str, order: str, values: list[str], scope: str = "scope") -> DataFrame:
    """Only events of the best scope count: requests are summed, of the others the last one stands."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SCOPES)), F.col(scope)) - 1, F.lit(len(SCOPES) - 1))
    rows = events.withColumn("_p", rank).withColumn("_best", F.min("_p").over(W.partitionBy(key))).filter("_p = _best")
    last = lambda c: F.max(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))["v"]
    return rows.groupBy(key).agg(last(scope).alias(scope), *(F.when(F.min("_p") == 0, F.sum(v)).otherwise(last(v)).alias(v) for v in values))


def classify_items(items: DataFrame, key: str, order: str, unknown_policy: str = "include") -> DataFrame:
    """items(key, order, role, kind, text, human, visible; the two flags may be NULL) -> category, layer and reason.

    ``unknown_policy`` places what has no evidence: include (main), separate (review) or metadata.
    """
    policy = {"include": "main", "separate": "review"}.get(unknown_policy, "metadata")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    text = F.col("kind") == "text"
    rows = turns(items, key, order, text & (F.col("role") == "user") & ~blank & F.coalesce("human", F.lit(True)), "_turn")
    answer = text & (F.col("role") == "assistant") & ~blank
    rows = rows.withColumn("_final", F.max(F.when(answer, F.col(order))).over(W.partitionBy(key, "_turn")))
    injected = F.col("role").isin("system", "developer") | ((F.col("role") == "user") & text & (F.col("human") == False))  # noqa: E712
    final = F.col(order).eqNullSafe(F.col("_final"))
    seen = F.coalesce("visible", F.lit(False))
    cases = [
        (injected, "instructions", F.lit("instructions"), "structural_instruction"),
        (text & (F.col("role") == "user") & F.coalesce("human", F.lit(False)), "human_input", F.lit("main"), "human_structural_evidence"),
        (text & (F.col("role") == "user"), "human_input", F.lit(policy), "legacy_ambiguous_authorship"),
        (answer & final & seen, "assistant_final", F.lit("main"), "harness_final_evidence"),
        (answer & final, "assistant_final", F.lit(policy), "ambiguous_final_or_visibility"),
        (text & (F.col("role") == "assistant") & seen, "assistant_other", F.lit("main"), "visible_assistant_text"),
        (text & (F.col("role") == "assistant"), "assistant_other", F.lit(policy), "legacy_ambiguous_visibility"),
    ]
    for kind in ("thought", "tool_call", "tool_result", "attachment"):
        cases.append((F.col("kind") == kind, kind, F.lit("main"), "canonical_kind"))
    category, layer, reason = F.lit("unknown"), F.lit(policy), F.lit("unclassified_canonical_kind")
    for test, c, l, r in reversed(cases):
        category, layer, reason = F.when(test, c).otherwise(category), F.when(test, l).otherwise(layer), F.when(test, r).otherwise(reason)
    return rows.withColumns({"category": category, "layer": layer, "reason": reason}).drop("_turn", "_final")


def export_table(df: DataFrame, path: str, keys: list[str]) -> str:
    """Writes a relation, reads it back and checks an order-free digest of its rows; gives the digest."""

    def digest(x: DataFrame) -> str:
        cols = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in sorted(x.columns)]
        row = F.sha2(F.concat_ws("\x1f", *cols), 256)
        parts = x.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("bigint")).alias(f"x{i}") for i in range(4)))
        return ":".join(str(v) for v in parts.first())

    before = digest(df)
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path) if keys else df.write.mode("overwrite").parquet(path)
    after = digest(df.sparkSession.read.parquet(path))
    if before != after:
        raise ValueError(f"{path}: what was read back differs from what was written")
    return after


# Names of filters and of optional fields, and what a preset exports.
FILTER_NAMES = ("harness", "harnessInstallation", "vendor", "model", "serviceProvider", "reasoningEffort", "host", "platform", "arch", "workspace", "dialogue", "revision")
OPTIONAL_FIELDS = (
    "dialogues.title", "hosts.label", "messages.timestamp", "messages.model", "messages.service_provider", "messages.reasoning_effort", "messages.response_status",
    "messages.usage", "chunks.tool_name", "chunks.source_locator", "chunks.raw_kind", "messages.raw_role",
)
CATEGORIES = ("human_input", "assistant_final", "assistant_other", "thought", "tool_call", "tool_result", "instructions", "usage", "attachment", "object", "unknown")
PRESETS = {
    "qa-analysis": ("human_input", "assistant_final"),
    "conversation": ("human_input", "assistant_final", "assistant_other"),
    "tools": ("tool_call", "tool_result"),
    "instructions": ("instructions",),
    "full-canonical": CATEGORIES,
}


def manifest(revisions: DataFrame, include: dict[str, list] | None = None, exclude: dict[str, list] | None = None, current_only: bool = True) -> DataFrame:
    """The ready revisions that an export takes: each included value must match, none of the excluded may.

    revisions has ``status``, ``is_current`` and a column for each filter that is named.  A NULL never matches an
    inclusion and is never excluded.  Empty lists filter nothing.
    """
    test = F.col("status") == "ready"
    if current_only:
        test = test & F.col("is_current")
    for filters, wanted in ((include or {}, True), (exclude or {}, False)):
        for name, values in filters.items():
            if name not in FILTER_NAMES:
                raise ValueError(f"no export filter {name}")
            if values:
                test = test & (F.col(name).isin(*values) if wanted else F.col(name).isNull() | ~F.col(name).isin(*values))
    return revisions.filter(test)


def preset_items(items: DataFrame, preset: str, category: str = "category") -> DataFrame:
    """The items of a preset's categories."""
    if preset not in PRESETS:
        raise ValueError(f"no export preset {preset}")
    return items.filter(F.col(category).isin(*PRESETS[preset]))


def whitelist(rows: DataFrame, relation: str, chosen: list[str]) -> DataFrame:
    """Optional fields of the relation are NULL unless they are chosen; all columns and types stay."""
    if unknown := sorted(set(chosen) - set(OPTIONAL_FIELDS)):
        raise ValueError(f"no optional fields {unknown}")
    hidden = {f.split(".")[1] for f in OPTIONAL_FIELDS if f.startswith(f"{relation}.") and f not in chosen}
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*(F.lit(None).cast(kinds[c]).alias(c) if c in hidden else F.col(c) for c in rows.columns))
