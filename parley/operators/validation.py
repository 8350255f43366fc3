"""Integrity rules as (rule, n) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(rule: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")


def violations(rule: str, df: DataFrame, test: Column) -> DataFrame:
    return _named(rule, df.filter(test))


def duplicates(rule: str, df: DataFrame, *keys: str) -> DataFrame:
    return _named(rule, df.groupBy(*keys).count().filter("count > 1"))


def foreign_keys(rules: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(rule, child, key, parent, key): children without a parent; a NULL key has none."""
    parts = [_named(rule, child.select(F.col(ck).alias("_k")).join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")) for rule, child, ck, parent, pk in rules]
    return reduce(DataFrame.unionByName, parts)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    left = a.join(b, key, "left_anti").select(F.lit(a_name).alias("side"), key)
    return left.unionByName(b.join(a, key, "left_anti").select(F.lit(b_name).alias("side"), key))


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n") for name, t in tables.items()])


def migration_reconciliation(rows: DataFrame) -> DataFrame:
    """rows(tab, category): matched, inserted, quarantined, or NULL for what no step has accounted for."""
    n = lambda c: F.count_if(F.col("category") == c).alias(c)
    return rows.groupBy("tab").agg(F.count(F.lit(1)).alias("total"), n("matched"), n("inserted"), n("quarantined"), F.count_if(F.col("category").isNull()).alias("lost"))


def recovery_source(raw: Column, payload: Column, normalized: Column) -> Column:
    return F.when(raw, "raw").when(payload, "payload").when(normalized, "normalized").otherwise("quarantine")


def raw_rules(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(rule, n) of manifest(id, sha256, size_bytes) against stored(id, sha256, size_bytes): one join of both."""
    both = manifest.alias("m").join(stored.alias("s"), F.col("m.id") == F.col("s.id"), "full")
    has_m, has_s = F.col("m.id").isNotNull(), F.col("s.id").isNotNull()
    rules = {
        "raw_missing": has_m & ~has_s, "raw_orphan": has_s & ~has_m, "raw_hash_mismatch": has_m & has_s & (F.col("m.sha256") != F.col("s.sha256")),
        "raw_size_mismatch": has_m & has_s & (F.col("m.size_bytes") != F.col("s.size_bytes")), "raw_hash_unknown": has_m & F.col("m.sha256").isNull(),
    }
    out = both.agg(*(F.count(F.when(test, 1)).alias(rule) for rule, test in rules.items()))
    return out.selectExpr(f"stack({len(rules)}, " + ", ".join(f"'{r}', {r}" for r in rules) + ") as (rule, n)")
