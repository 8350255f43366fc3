"""Digests of ordered tables: a tree of SHA-256 over runs of ``FANOUT`` rows, then over runs of as many digests.

Order counts, since a run hashes its rows in order; no task ever holds more than a run; and two trees that differ tell which
runs of rows differ.  A row is ``<length of id>:<id>`` and ``N;`` for a NULL content or ``S<length>:<content>;``, so NULL and
the empty text differ and no two rows read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.storage import numbered, settled, shared_path

FANOUT = 256


def payload(id_: str, content: str) -> Column:
    """SHA-256 of a row's id and content."""
    i, c = F.coalesce(F.col(id_).cast("string"), F.lit("")), F.col(content)
    return F.sha2(F.concat(F.length(i), F.lit(":"), i, F.when(c.isNull(), "N;").otherwise(F.concat(F.lit("S"), F.length(c), F.lit(":"), c, F.lit(";")))), 256)


def same(by: list[str]) -> Column:
    """Rows r and f are of one group; NULL is a group."""
    test = F.lit(True)
    for c in by:
        test = test & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    return test


def in_order(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows with ``rank`` from 0 by ``order`` (which should be unique), within each group of ``by``.

    Rows go to range partitions once; ranks are counted over files, and a group's first rank is taken off.
    """
    by, spark = by or [], rows.sparkSession
    path = shared_path(spark, "ordered")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).write.parquet(path)
    ranked = numbered(spark, path, rows.columns)
    if not by:
        return ranked
    first = ranked.groupBy(*by).agg(F.min("rank").alias("_first"))
    return ranked.alias("r").join(first.alias("f"), same(by)).select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("r.rank") - F.col("_first")).alias("rank"))


def tree(ranked: DataFrame, digest: str = "digest", by: list[str] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(*by, level, node, n_rows, digest): level 1 over rows with ``rank`` and ``digest``, up to one root a group."""
    by = by or []
    level, nodes, out = 1, ranked.select(*by, F.floor(F.col("rank") / fanout).alias("node"), "rank", F.col(digest).alias("digest"), F.lit(1).alias("n_rows")), None
    while True:
        run = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        nodes = nodes.groupBy(*by, "node").agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(run, ""), 256).alias("digest"))
        nodes = settled(nodes, f"digests-{level}")
        now = nodes.select(*by, F.lit(level).alias("level"), "node", "n_rows", "digest")
        out = now if out is None else out.unionByName(now)
        # Groups with one node have their root; the others go on.
        if by:
            more = nodes.groupBy(*by).agg(F.max("node").alias("_top")).filter("_top > 0")
            nodes = nodes.alias("r").join(more.alias("f"), same(by), "left_semi")
        if (nodes.agg(F.max("node")).first()[0] or 0) == 0:
            return out
        nodes = nodes.select(*by, F.floor(F.col("node") / fanout).alias("node"), F.col("node").alias("rank"), "digest", "n_rows")
        level += 1


def roots(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, n_rows, digest) of the root of each group, whatever the heights of the others."""
    by = by or []
    return nodes.groupBy(*by).agg(F.max_by(F.struct("n_rows", "digest"), "level").alias("r")).select(*by, "r.*")


def id_roots(rows: DataFrame, by: list[str], depth: int) -> DataFrame:
    """rows(*by, id, digest) -> (*by, n_rows, digest) of a tree over the ids' hashes: leaves are the runs of ids whose hash
    starts alike in ``depth`` hex digits, in the order of hash and id, and sixteen nodes make one above.

    The order is that of the hash, so nothing is ranged or ranked; a depth of log16(rows / FANOUT) makes runs of some FANOUT.
    """
    nodes = rows.select(*by, F.sha2(F.col("id").cast("string"), 256).alias("place"), "id", "digest", F.lit(1).alias("n_rows"))
    run = lambda *order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "digest"))), lambda x: x["digest"]), ""), 256).alias("digest")
    nodes = nodes.groupBy(*by, F.substring("place", 1, depth).alias("node")).agg(F.sum("n_rows").alias("n_rows"), run("place", "id"))
    for k in range(depth - 1, -1, -1):
        nodes = nodes.groupBy(*by, F.substring("node", 1, k).alias("up")).agg(F.sum("n_rows").alias("n_rows"), run("node")).withColumnRenamed("up", "node")
    return nodes.drop("node")


def set_digests(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(*by, digest) -> (*by, n_rows, digest) over the digests of a group whatever their order, repeats counted.

    Two 64-bit hashes of the rows' digests are summed up by halves, so tasks send one row a group and nothing is sorted.  The rows' digests
    should name them by id (see ``payload``): then exchanged texts differ too.  Sums are exact up to two thousand million rows.
    """
    hashes = [F.xxhash64("digest"), F.xxhash64("digest", F.lit("again"))]
    halves = {f"w{2 * i + j}": x for i, h in enumerate(hashes) for j, x in enumerate((F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))))}
    sums = rows.select(*by, *(x.alias(w) for w, x in halves.items())).groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(w).alias(w) for w in halves))
    return sums.select(*by, "n_rows", F.sha2(F.concat_ws(",", "n_rows", *halves), 256).alias("digest"))


def differing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(level, node, expected, found) of the nodes at which two trees differ; NULL where one has none.  Level 1 names runs of rows."""
    a, b = expected.select("level", "node", F.col("digest").alias("expected")), found.select("level", "node", F.col("digest").alias("found"))
    return a.join(b, ["level", "node"], "full").filter(~F.col("expected").eqNullSafe(F.col("found")))


def stored_tree(spark: SparkSession, path: str, id_: str, content: str, fanout: int = FANOUT) -> DataFrame:
    """The tree of what a dataset's files hold, in the order in which they hold it."""
    return tree(numbered(spark, path, [id_, content]).select("rank", payload(id_, content).alias("digest")), fanout=fanout)


class PayloadMismatch(ValueError):
    """What was read back isn't what was to be written."""


def write_verified(rows: DataFrame, path: str, id_: str, content: str, fanout: int = FANOUT) -> DataFrame:
    """Writes rows in the order of ``id_`` and gives the tree of what the files hold; raises unless it is that of the rows.

    The expected tree comes from the rows, the other from the files, in the order of the files.  Ids should be unique.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    expected = tree(in_order(rows.select(id_, payload(id_, content).alias("digest")), [id_]), fanout=fanout)
    rows.repartitionByRange(parts, id_).sortWithinPartitions(id_).write.parquet(path)
    found = stored_tree(spark, path, id_, content, fanout)
    wrong = [r.node for r in differing(expected, found).filter("level = 1").select("node").orderBy("node").limit(10).collect()]
    if wrong:
        raise PayloadMismatch(f"{path}: runs {wrong} of {fanout} rows differ from what was to be written")
    return found
