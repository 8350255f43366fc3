"""The corpus pipeline: quality rules, near copies, benchmark leaks, source mix, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import materialize, work_path
from parley.llm.decontamination import drop_leaks
from parley.llm.mixing import mix_sources
from parley.llm.near_copies import drop_near_copies
from parley.llm.quality_rules import apply_rules, labelled_sample, learn_rules
from parley.llm.tokens import token_digest, write_tokens
from parley.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects.

    Null and empty texts have no words, so the base rules reject them.  Rows that repeat, and null ids, are judged by
    their text.  Without labels of both classes the list is empty.  An empty table gives an empty one; other columns,
    whatever their names, pass through.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_rules(docs, learn_rules(*labelled_sample(docs, labels)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, a null one last.

    Texts without a word are copies of each other; of rows that repeat whole one stays; of equal ids with different texts
    the smaller hash of the text goes first.  An empty table gives an empty one; other columns pass through.
    """
    ship(spark)
    return drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none.  Rows that repeat are judged alike, and null ids like any other.  Items without a
    word match nothing; without items, or without documents, nothing changes; other columns pass through.
    """
    ship(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix wants them, shuffled.

    A null source is a source of its own.  Rows that repeat get the same count each, since it is hashed from the id; a
    null id hashes as the word null.  Null texts are copied like others.  An empty table gives an empty one; other columns
    pass through.
    """
    ship(spark)
    mixed, copy, key = mix_sources(docs)
    return mixed.drop(copy, key)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document what they hold: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone.  Copies and rows that repeat are written each; null ids come first.  An
    empty table gives no rows; other columns are left out.
    """
    ship(spark)
    path = work_path(spark, "pipeline-tokens")
    write_tokens(docs, path)
    return token_digest(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: Learned rules, fingerprints and the tokenizer can't be told in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
