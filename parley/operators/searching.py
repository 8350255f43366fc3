"""The search interface: filters, snippets, modes and how they degrade."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import retrieval as R

SNIPPET = 400
MIN_CANDIDATES, MOST_CANDIDATES, OVERFETCH = 50, 1000, 3


@dataclass(frozen=True)
class SearchFilters:
    """Twelve optional filters, all of which must hold.  Bounds of time are inclusive."""

    harness: str | None = None
    host: str | None = None
    user: str | None = None
    workspace: str | None = None
    vendor: str | None = None
    model: str | None = None
    effort: str | None = None
    role: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    deleted_only: bool = False
    document_type: str | None = None

    def any(self) -> bool:
        return any(getattr(self, f.name) not in (None, False) for f in fields(self))

    def condition(self) -> Column:
        """Over columns harness, host_label, hostname, user, workspace, vendor, dialogue_vendor, model, raw_model, ..."""
        c, test = F.col, F.lit(True)
        for name in ("harness", "user", "workspace", "effort", "role", "document_type"):
            if (v := getattr(self, name)) is not None:
                test = test & (c(name) == v)
        if self.host is not None:
            test = test & ((c("host_label") == self.host) | (c("hostname") == self.host))
        if self.vendor is not None:
            test = test & (F.coalesce("vendor", "dialogue_vendor") == self.vendor)
        if self.model is not None:
            test = test & ((c("model") == self.model) | (c("raw_model") == self.model) | F.array_contains("model_aliases", self.model))
        at = F.coalesce("message_ts", "updated_at")
        if self.since is not None:
            test = test & (at >= F.lit(self.since))
        if self.until is not None:
            test = test & (at <= F.lit(self.until))
        return test & (c("presence") == "deleted") if self.deleted_only else test


def reject_forensic(**flags: bool) -> None:
    """Flags for raw material are refused before anything is read."""
    given = sorted(k for k, v in flags.items() if v)
    if given:
        raise ValueError(f"search can't serve {', '.join(given)}")


def candidates(limit: int) -> int:
    return min(MOST_CANDIDATES, max(MIN_CANDIDATES, OVERFETCH * limit))


def search(index: DataFrame, n_docs: int, avg_len: float, context: DataFrame, query: str, filters: SearchFilters | None = None, mode: str = "text", vectors: DataFrame | None = None, query_vector: list[float] | None = None, limit: int = 20) -> DataFrame:
    """Ranked hits with their context.  Filters hold before the top is taken; hybrid without vectors is text.

    context: one row a document with ``doc_id``, ``message_id``, ``dialogue_id`` and the filters' columns.
    """
    if mode not in ("text", "vector", "hybrid"):
        raise ValueError(f"no search mode {mode}")
    if mode != "text" and (vectors is None or query_vector is None):
        if mode == "vector":
            raise ValueError("vector search needs vectors and a query vector")
        mode = "text"
    spark = index.sparkSession
    allowed = context.filter(filters.condition()) if filters and filters.any() else context
    ids, k = allowed.select("doc_id"), candidates(limit)
    legs = []
    if mode in ("text", "hybrid"):
        q = spark.createDataFrame([(0, query)], "query_id long, text string")
        # Frequencies are those of the whole index, so filters never change a score; they hold before the top is taken.
        hits = R.bm25(index, n_docs, avg_len, q)
        legs.append(R.top_k(hits.join(ids, "doc_id", "left_semi") if filters and filters.any() else hits, k, ["query_id"]))
    if mode in ("vector", "hybrid"):
        q = spark.createDataFrame([(0, query_vector)], "query_id long, query array<float>")
        legs.append(R.cosine_search(vectors.join(ids.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi"), q, k))
    hits = R.reciprocal_rank_fusion(*legs) if len(legs) > 1 else legs[0].select("query_id", "doc_id", "score")
    hits = R.top_k(hits.join(allowed, "doc_id"), k, ["query_id"])
    key = F.coalesce(F.col("message_id").cast("string"), F.col("doc_id").cast("string"))
    hits = R.first_by(hits.withColumn("_message", key), ["query_id", "_message"], ["rank"]).drop("_message")
    return R.diversify(hits, "dialogue_id", ["query_id"]).orderBy("rank").limit(limit)


def snippet(text: Column, terms: list[str], width: int = SNIPPET) -> Column:
    """Text around the first term, a third of the width ahead of it, at whole words, terms in ``<em>``."""
    low = F.lower(text)
    spots = [F.nullif(F.locate(t.lower(), low), F.lit(0)) for t in terms]
    anchor = F.coalesce(F.array_min(F.array_compact(F.array(*spots))) if spots else F.lit(1), F.lit(1))
    start = F.greatest(anchor - width // 3, F.lit(1))
    cut = F.substr(text, start, F.lit(width))
    cut = F.when(start > 1, F.concat(F.lit("…"), F.regexp_replace(cut, r"^\S*\s", ""))).otherwise(cut)
    cut = F.when(start + width <= F.length(text), F.concat(F.regexp_replace(cut, r"\s\S*$", ""), F.lit("…"))).otherwise(cut)
    for t in terms:
        quoted = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in t)
        cut = F.regexp_replace(cut, rf"(?i)(?<![\p{{L}}\p{{N}}])({quoted})(?![\p{{L}}\p{{N}}])", "<em>$1</em>")
    return cut
