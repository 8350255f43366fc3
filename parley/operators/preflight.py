"""What a migration finds before it starts: coverage of payloads, orphans, duplicates and where the data come from.

Every table is read once.  Totals are observed while the pass that needs the rows anyway is running; what concerns single
threads comes from one grouping of the records and one join with the threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parley.functions.documents import host_class
from parley.operators.storage import settled


def preflight(agents: DataFrame, projects: DataFrame, threads: DataFrame, records: DataFrame, backups: DataFrame) -> DataFrame:
    """(figure, n).

    agents(agent_id), projects(project_id), threads(thread_id, external_id, agent_id, project_id, path),
    records(thread_id, source_file_id, payload), backups(source_file_id), one row a file at most.  A payload covers a record
    if it isn't empty and is JSON; a thread is covered fully, in part or not at all.
    """
    seen_records, seen_threads = Observation(), Observation()
    c, n = F.col, lambda test: F.count(F.when(test, 1))
    present = F.length(F.coalesce("payload", F.lit(""))) > 0
    valid = present & F.try_parse_json("payload").isNotNull()
    rows = records.select("thread_id", "source_file_id", present.alias("present"), valid.alias("valid"))
    rows = rows.observe(seen_records, F.count(F.lit(1)).alias("records"), n(c("present")).alias("payload_present"), n(c("valid")).alias("payload_valid"), n(c("source_file_id").isNull()).alias("records_without_file"))
    kept = backups.select("source_file_id").withColumn("kept", F.lit(True))
    # Files first: a thread's records are many, its files few.
    files = rows.groupBy("thread_id", "source_file_id").agg(F.count(F.lit(1)).alias("n"), n(c("valid")).alias("valid")).join(kept, "source_file_id", "left")
    cover = files.groupBy("thread_id").agg(F.sum("n").alias("n"), F.sum("valid").alias("valid"), F.count("source_file_id").alias("files"), n(c("kept") & c("source_file_id").isNotNull()).alias("kept"))
    known = threads.observe(seen_threads, F.count(F.lit(1)).alias("threads"))
    known = known.join(agents.select("agent_id").withColumn("has_agent", F.lit(True)), "agent_id", "left")
    known = known.join(projects.select("project_id").withColumn("has_project", F.lit(True)), "project_id", "left")
    known = known.select("thread_id", "agent_id", "external_id", host_class(c("path"))["system"].alias("host"), c("has_agent").isNull().alias("no_agent"), (c("project_id").isNotNull() & c("has_project").isNull()).alias("no_project"))
    both = settled(known.withColumn("is_thread", F.lit(True)).join(cover, "thread_id", "full_outer"), "preflight")
    of, on = F.coalesce("is_thread", F.lit(False)), F.coalesce("n", F.lit(0)) > 0
    figures = {
        "threads_without_agent": n(of & c("no_agent")), "threads_without_project": n(of & c("no_project")), "records_without_thread": F.coalesce(F.sum(F.when(~of, c("n"))), F.lit(0)),
        "threads_covered": n(of & on & (c("valid") == c("n"))), "threads_covered_in_part": n(of & on & (c("valid") > 0) & (c("valid") < c("n"))), "threads_uncovered": n(of & (~on | (c("valid") == 0))),
        "threads_with_all_backups": n(of & (c("files") > 0) & (c("kept") == c("files"))),
    }
    out = both.agg(*(x.cast("bigint").alias(f) for f, x in figures.items()))
    out = out.selectExpr(f"stack({len(figures)}, " + ", ".join(f"'{f}', {f}" for f in figures) + ") as (figure, n)")
    twice = both.filter(of).groupBy("agent_id", "external_id").agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0")
    twice = twice.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n")).select(F.lit("threads_repeated").alias("figure"), "n")
    hosts = both.filter(of).groupBy(F.concat(F.lit("host:"), c("host")).alias("figure")).agg(F.count(F.lit(1)).alias("n"))
    totals = both.sparkSession.createDataFrame(sorted((seen_records.get | seen_threads.get).items()), "figure string, n bigint")
    return out.unionByName(twice).unionByName(hosts).unionByName(totals)
