"""Search documents of a dialogue: its prompts and its final answers, by the rules of its source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.segments import segment_documents
from parley.operators.sequences import ordered_text, turns


@dataclass(frozen=True)
class Rule:
    """How a source marks turns and finals."""

    boundary: str  # "prompt": a message that yields one; "human": any that a person wrote
    whole_turn: bool = True  # the final is all visible answers of the turn, else the last one
    needs_visible: bool = False  # unknown visibility isn't enough


# The rules of the eight sources.
RULES = {
    "codex": Rule("prompt", whole_turn=False), "claude-code": Rule("human"), "claude-desktop": Rule("human"), "opencode": Rule("prompt"),
    "cursor": Rule("human"), "qwen-code": Rule("prompt", needs_visible=True), "kimi-code": Rule("prompt"), "omp": Rule("prompt", needs_visible=True),
}


def _by_rule(test) -> Column:
    names = [h for h, r in RULES.items() if test(r)]
    return F.col("harness").isin(*names)


def search_documents(messages: DataFrame) -> DataFrame:
    """messages(harness, dialogue_id, sequence, role, human_authored, visible, text) -> prompts and finals.

    A prompt is a person's non-blank message (authorship that is unknown counts); the final is a turn's visible answer.
    Gives (harness, dialogue_id, turn_no, document_type, content).
    """
    said = F.trim(F.coalesce("text", F.lit(""))) != ""
    person = (F.col("role") == "user") & F.coalesce("human_authored", F.lit(True))
    boundary = F.when(_by_rule(lambda r: r.boundary == "prompt"), person & said).otherwise(person)
    key = F.concat_ws("\x1f", "harness", "dialogue_id")
    rows = turns(messages.withColumn("_key", key), "_key", "sequence", boundary, "turn_no").filter("turn_no > 0")
    prompts = rows.filter(person & said).select("harness", "dialogue_id", "turn_no", F.lit("user_prompt").alias("document_type"), F.col("text").alias("content"))
    visible = F.coalesce("visible", ~_by_rule(lambda r: r.needs_visible))
    answers = rows.filter((F.col("role") == "assistant") & said & visible)
    last = F.max("sequence").over(W.partitionBy("_key", "turn_no"))
    answers = answers.withColumn("_last", last).filter(_by_rule(lambda r: r.whole_turn) | (F.col("sequence") == F.col("_last")))
    finals = answers.groupBy("harness", "dialogue_id", "turn_no").agg(ordered_text(["turn_no"], "sequence", "text").alias("content"))
    return prompts.unionByName(finals.select("harness", "dialogue_id", "turn_no", F.lit("assistant_final").alias("document_type"), "content"))


def prepared_documents(messages: DataFrame) -> DataFrame:
    """Search documents cut into segments, with deterministic ids."""
    cut = segment_documents(search_documents(messages), "content")
    parts = ("harness", "dialogue_id", "turn_no", "document_type", "segment_no")
    return cut.withColumn("document_id", F.concat(F.lit("doc_"), F.sha2(F.concat_ws("|", *(F.col(p).cast("string") for p in parts), "content"), 256)))
