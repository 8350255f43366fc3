"""Dimension resolution, quarantine, reparse selection, attribution and privacy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.sequences import first_by


def resolve_workspaces(seen: DataFrame, known: DataFrame) -> DataFrame:
    """seen(id, host, path, repository) with known(workspace_id, host, path, repository) -> workspace_id and how it was found.

    A repository identity beats a path on the same host; names alone never join two workspaces.
    """
    by_repo = known.filter("repository is not null").groupBy("repository").agg(F.min("workspace_id").alias("_repo"))
    by_path = known.groupBy("host", "path").agg(F.min("workspace_id").alias("_path"))
    out = seen.join(by_repo, "repository", "left").join(by_path, ["host", "path"], "left")
    how = F.when(F.col("_repo").isNotNull() & F.col("_path").isNotNull() & (F.col("_repo") != F.col("_path")), "relinked").when(F.col("_repo").isNotNull(), "repository").when(F.col("_path").isNotNull(), "path").otherwise("new")
    return out.select("id", F.coalesce("_repo", "_path").alias("workspace_id"), how.alias("found_by"))


def merge_errors(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Quarantine rows(keys, first_failed, last_failed, n), one for each identity; NULL equals NULL."""
    rows = known.unionByName(new)
    return rows.groupBy(*keys).agg(F.min("first_failed").alias("first_failed"), F.max("last_failed").alias("last_failed"), F.sum("n").alias("n"))


def resolve_errors(errors: DataFrame, revisions: DataFrame, run: int) -> DataFrame:
    """errors(revision_id, run, resolved) of earlier runs are resolved once their revision is parsed."""
    parsed = revisions.filter("status = 'parsed'").select("revision_id").distinct().withColumn("_ok", F.lit(True))
    out = errors.join(parsed, "revision_id", "left")
    return out.withColumn("resolved", F.col("resolved") | (F.coalesce("_ok", F.lit(False)) & (F.col("run") < run))).drop("_ok")


def select_reparse(current: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(current revisions to parse again, wanted keys that have none)."""
    return current.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(current, key, "left_anti")


def attribute_orphans(orphans: DataFrame, provenance: DataFrame) -> DataFrame:
    """orphans(sha256) with provenance(sha256, location): repairable where one location is named, else manual."""
    n = provenance.groupBy("sha256").agg(F.countDistinct("location").alias("_n"), F.min("location").alias("_l"))
    out = orphans.join(n, "sha256", "left")
    return out.select("sha256", F.when(F.col("_n") == 1, "repairable").otherwise("manual").alias("action"), F.when(F.col("_n") == 1, F.col("_l")).alias("location"))


def privacy_plan(documents: DataFrame, jobs: DataFrame, vectors: DataFrame) -> DataFrame:
    """documents(doc_id, reason) with jobs(doc_id, status) and vectors(doc_id) -> what to do with each document."""
    v = vectors.select("doc_id").distinct().withColumn("_v", F.lit(True))
    out = documents.join(jobs, "doc_id", "left").join(v, "doc_id", "left")
    barred, has = F.col("reason").isNotNull(), F.coalesce("_v", F.lit(False))
    action = (
        F.when(barred & has, "drop_vector").when(barred & F.col("status").isin("pending", "leased"), "cancel_job")
        .when(~barred & ((F.col("status") == "cancelled") | (F.col("status").isNull() & ~has)), "enqueue").otherwise("keep")
    )
    return out.select("doc_id", "reason", action.alias("action"))


def latest_attempts(quarantine: DataFrame) -> DataFrame:
    """The latest attempt of each lineage key."""
    return first_by(quarantine, ["lineage_key"], [F.desc("attempt"), F.desc("id")])


def exclusion_eligible(quarantined: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Quarantined rows whose content is already covered elsewhere."""
    return quarantined.join(covered.select(*keys).distinct(), keys, "left_semi")


def vector_audit(vectors: DataFrame, jobs: DataFrame, dimension: int) -> DataFrame:
    """(problem, n): wrong dimensions, vectors of unfinished jobs, finished jobs without a vector."""
    wrong = vectors.filter(F.size("vector") != dimension).select(F.lit("wrong_dimension").alias("problem"))
    done = jobs.filter("status = 'completed'")
    early = vectors.join(done, "doc_id", "left_anti").select(F.lit("vector_without_completed_job").alias("problem"))
    lost = done.join(vectors, "doc_id", "left_anti").select(F.lit("completed_job_without_vector").alias("problem"))
    return wrong.unionByName(early).unionByName(lost).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def thread_json(messages: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One JSON document a thread, its messages in order and only of the given columns."""
    item = F.struct(F.col(order).alias("o"), F.struct(*columns).alias("m"))
    g = messages.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("messages"))
    return g.select(key, F.to_json(F.struct(key, "messages")).alias("document"))


def mapped_session_time(sessions: DataFrame, groups: DataFrame) -> DataFrame:
    """sessions(model, harness, active_ms) attributed to the groups(model, harness) that exist."""
    by = sessions.groupBy("model", "harness").agg(F.sum("active_ms").alias("active_ms"), F.count(F.lit(1)).alias("sessions"))
    return groups.join(by, ["model", "harness"], "left").fillna({"active_ms": 0, "sessions": 0})


def open_turns(events: DataFrame) -> DataFrame:
    """events(session, ms, kind of started / complete / aborted) -> turns with their duration and how they ended.

    A start ends the turn before it; the last event of the session ends an open one.
    """
    w = W.partitionBy("session").orderBy("ms")
    rows = events.withColumn("turn", F.sum(F.when(F.col("kind") == "started", 1).otherwise(0)).over(w)).filter("turn > 0")
    end = F.min(F.when(F.col("kind").isin("complete", "aborted"), F.struct("ms", "kind")))
    g = rows.groupBy("session", "turn").agg(F.min("ms").alias("start"), F.max("ms").alias("last"), end.alias("e"))
    return g.select("session", "turn", (F.coalesce("e.ms", "last") - F.col("start")).alias("duration_ms"), F.coalesce("e.kind", F.lit("incomplete")).alias("outcome"))
