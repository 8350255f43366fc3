"""Judgment sets as tables, and scenarios that are measured against them on a corpus that must not change meanwhile."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import digests as D
from parley.operators.retrieval import ranking_metrics
from parley.operators.storage import settled

# Bounds of a judgment set, and what its queries may be.
LEAST_QUERIES, MOST_QUERIES = 50, 100
LANGUAGES = ("ru", "en", "mixed")
QUERY_TYPES = ("exact phrase", "russian morphology", "english technical", "function name", "model", "path", "semantic paraphrase", "mixed ru/en", "code error", "deleted dialogue")


class JudgmentError(ValueError):
    """The judgment set can't be used; says why."""


class CorpusDrift(RuntimeError):
    """The corpus isn't the one that the run is bound to."""


def judgment_problems(queries: DataFrame, expected: DataFrame, must_not: DataFrame, least: int = LEAST_QUERIES, most: int = MOST_QUERIES, languages: tuple = LANGUAGES, types: tuple = QUERY_TYPES) -> DataFrame:
    """(query_id, problem) of a set: queries(query_id, text, language, query_type), expected(query_id, doc_id, grade), must_not(query_id, text).

    A NULL query_id names the set itself, whose size is out of bounds.
    """
    said = lambda problem, test, rows=queries: rows.filter(test).select("query_id", F.lit(problem).alias("problem"))
    blank = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    size = queries.agg(F.count(F.lit(1)).alias("n")).filter(~F.col("n").between(least, most)).select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit("number_of_queries").alias("problem"))
    again = lambda rows, *keys: rows.groupBy(*keys).count().filter("count > 1").select("query_id").distinct()
    found = [
        size, said("no_text", blank("text")), said("language", ~F.coalesce(F.col("language").isin(*languages), F.lit(False))), said("query_type", ~F.coalesce(F.col("query_type").isin(*types), F.lit(False))),
        said("repeated_id", F.lit(True), again(queries, "query_id")), said("nothing_expected", F.lit(True), queries.join(expected, "query_id", "left_anti")), said("expected_twice", F.lit(True), again(expected, "query_id", "doc_id")),
        said("grade", ~F.coalesce(F.col("grade").between(1, 3), F.lit(False)), expected), said("nothing_forbidden", F.lit(True), queries.join(must_not.filter(~blank("text")), "query_id", "left_anti")),
    ]
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def validated(queries: DataFrame, expected: DataFrame, must_not: DataFrame, **bounds) -> None:
    """Raises with up to ten of the problems, unless there is none."""
    wrong = [f"{r.query_id}: {r.problem}" for r in judgment_problems(queries, expected, must_not, **bounds).orderBy("query_id", "problem").limit(10).collect()]
    if wrong:
        raise JudgmentError("; ".join(wrong))


def corpus_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[int, str]:
    """Documents and root digest of a corpus in the order of its ids."""
    root = D.roots(D.tree(D.in_order(docs.select(doc_id, D.payload(doc_id, text).alias("digest")), [doc_id]))).first()
    return (root.n_rows, root.digest) if root else (0, "")


def run_scenarios(corpus: Callable[[], DataFrame], scenarios: dict[str, Callable[[DataFrame], DataFrame]], queries: DataFrame, expected: DataFrame, must_not: DataFrame, bound_to: tuple[int, str] | None = None, **bounds) -> DataFrame:
    """Measures of each scenario and query: the columns of ``ranking_metrics``, ``forbidden`` and the corpus digest.

    A scenario maps queries(query_id, text) to ranked(query_id, doc_id, rank).  ``corpus`` gives the documents as they are
    now; their digest is taken before the first and after every scenario and must not change, nor differ from ``bound_to``.
    ``forbidden`` counts texts that must not match and are found in the first ten documents.
    """
    if not scenarios:
        raise ValueError("no scenario to run")
    validated(queries, expected, must_not, **bounds)
    before = corpus_digest(corpus())
    if bound_to is not None and before != bound_to:
        raise CorpusDrift(f"the corpus has digest {before}, the run is bound to {bound_to}")
    out = None
    for name, scenario in scenarios.items():
        ranked = settled(scenario(queries.select("query_id", "text")), "ranked")
        best = F.broadcast(ranked.filter("rank <= 10").select("query_id", "doc_id"))  # ten rows a query, so no texts are shuffled
        top = corpus().select("doc_id", F.lower("text").alias("body")).join(best, "doc_id").select("query_id", "body")
        bad = top.join(must_not.select("query_id", F.lower("text").alias("bad")), "query_id").filter(F.contains("body", "bad")).groupBy("query_id").agg(F.countDistinct("bad").alias("forbidden"))
        measures = ranking_metrics(ranked, expected).join(bad, "query_id", "left").withColumn("forbidden", F.coalesce("forbidden", F.lit(0)))
        measures = measures.select(F.lit(name).alias("scenario"), "*", F.lit(before[1]).alias("corpus"))
        out = measures if out is None else out.unionByName(measures)
        after = corpus_digest(corpus())
        if after != before:
            raise CorpusDrift(f"the corpus changed during {name}: {before} before, {after} after")
    return out
