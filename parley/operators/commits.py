"""Tables that change by commits: only the buckets that a batch touches are written anew, and one file makes them current.

A table is a folder.  ``data/<commit>/bucket=<b>`` has a bucket's rows as one commit wrote them; ``commits/<n>.json`` names,
for each bucket, the commit whose rows are current, and appears whole or not at all.  Readers take the last such file, so
they see a commit's rows all together or not at all, and a batch that fails leaves what was.  Of two writers at the same
version one is refused.  A batch has a token; a batch whose token is known changes nothing, so it may be run again.

Rows are spread over a fixed number of buckets by their keys.  Null keys equal each other.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.operators.storage import Files, settled

BUCKETS = 16


class CommitConflict(RuntimeError):
    """Another writer has made this version."""


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


class CommitTable:
    """A table at a path, keyed by ``keys``; rows go to buckets by ``bucket_by``, some of the keys or all."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS, bucket_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.files = spark, path.rstrip("/"), keys, Files(spark, path)
        now = self.manifest() or {}
        self.buckets, self.bucket_by = now.get("buckets", buckets), now.get("bucket_by", bucket_by or keys)

    # -------------------------------------------------------------- reading

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names("commits") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict | None:
        found = self.versions()
        if not found or (version is not None and version not in found):
            return None
        return json.loads(self.files.read(f"commits/{found[-1] if version is None else version:08d}.json"))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, by default the current one; of some buckets if ``only`` names them."""
        now = self.manifest(version)
        if now is None:
            raise ValueError(f"{self.path} has no version {'yet' if version is None else version}")
        schema = StructType.fromJson(now["schema"])
        paths = [f"{self.path}/data/{c}/bucket={b}" for b, c in sorted(now["current"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        # A hash skips NULLs, so a marker of which keys are NULL goes with them.
        return F.pmod(F.xxhash64(*self.bucket_by, *(F.col(k).isNull() for k in self.bucket_by)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with these keys lie in."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # ``buckets`` rows at most

    # -------------------------------------------------------------- writing

    def dealt(self, rows: DataFrame, touched: list[int]) -> DataFrame:
        """Rows with ``bucket``, those of a bucket in one task; this is the one shuffle of a commit."""
        return rows.withColumn("bucket", self.bucket()).repartition(max(len(touched), 1), "bucket")

    def _commit(self, changed: DataFrame, touched: list[int], token: str, note: dict, base: dict | None) -> int:
        """Writes the buckets in ``touched`` from ``changed``, which was dealt, and makes them current after version ``base``."""
        version = base["version"] + 1 if base else 1
        name, current = f"{version:08d}-{token}", dict(base["current"]) if base else {}
        changed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        # A bucket that lost all rows has no folder.
        written = {int(n.split("=")[1]) for n in self.files.names(f"data/{name}") if n.startswith("bucket=")}
        for b in touched:
            current.pop(str(b), None)
            if b in written:
                current[str(b)] = name
        schema = json.loads(changed.drop("bucket").schema.json())
        tokens = [*(base["tokens"] if base else []), token]
        body = {"version": version, "buckets": self.buckets, "bucket_by": self.bucket_by, "keys": self.keys, "schema": schema, "current": current, "tokens": tokens, "note": note}
        if not self.files.publish(f"commits/{version:08d}.json", json.dumps(body)):
            raise CommitConflict(f"{self.path}: version {version} was made by another writer")
        return version

    def merge(self, batch: DataFrame, token: str, latest_by: list[str] | None = None, note: dict | None = None) -> int:
        """Rows of the batch replace those of equal keys and are added otherwise; gives the version that holds them.

        Of rows of the batch with equal keys the one that is greatest by ``latest_by`` stays (the whole row, column by
        column, where that is a tie).  Columns must be those of the table.
        """
        base = self.manifest()
        if base and token in base["tokens"]:
            return base["version"]
        if base and [f["name"] for f in base["schema"]["fields"]] != batch.columns:
            raise ValueError(f"{self.path}: columns {batch.columns} aren't those of the table")
        rest = [c for c in batch.columns if c not in self.keys]
        order = [*(latest_by or []), *(c for c in rest if c not in (latest_by or []))]
        touched = self.touched(batch)  # reads keys alone
        rows = batch.withColumn("_new", F.lit(True))
        if base:
            rows = self.read(only=touched).select(*batch.columns).withColumn("_new", F.lit(False)).unionByName(rows)
        # Grouped where the buckets lie: a row of the batch wins over a stored one.
        pick = F.max(F.struct("_new", *order)).alias("_row")
        one = self.dealt(rows, touched).groupBy("bucket", *self.keys).agg(pick)
        one = one.select(*(F.col(c) if c in self.keys else F.col(f"_row.{c}") for c in batch.columns), "bucket")
        return self._commit(one, touched, token, note or {}, base)

    def delete(self, batch: DataFrame, token: str, note: dict | None = None) -> int:
        """Removes the rows whose keys the batch has."""
        base = self.manifest()
        if base is None or token in base["tokens"]:
            return base["version"] if base else 0
        gone = settled(batch.select(*self.keys).distinct(), "gone")
        touched = self.touched(gone)
        rest = self.read(only=touched).alias("o").join(gone.alias("n"), same_keys("o", "n", self.keys), "left_anti")
        return self._commit(self.dealt(rest.select("o.*"), touched), touched, token, note or {}, base)

    def update(self, change: dict[str, Column], where: Column, token: str, note: dict | None = None) -> int:
        """Sets columns of the rows that ``where`` holds for; buckets without such rows keep their files, and no row no commit."""
        base = self.manifest()
        if base is None or token in base["tokens"]:
            return base["version"] if base else 0
        touched = self.touched(self.read().filter(where))
        if not touched:
            return base["version"]
        kinds = {f.name: f.dataType for f in StructType.fromJson(base["schema"]).fields}
        new = {c: F.when(where, x).otherwise(F.col(c)).cast(kinds[c]).alias(c) for c, x in change.items()}
        rows = self.read(only=touched)
        return self._commit(self.dealt(rows.select(*(new.get(c, F.col(c)) for c in rows.columns)), touched), touched, token, note or {}, base)

    def vacuum(self, keep: int = 1) -> int:
        """Forgets all but the last ``keep`` versions and removes buckets that none of these has; gives their number."""
        versions, gone = self.versions(), 0
        if not versions:
            return 0
        used = {(c, int(b)) for v in versions[-keep:] for b, c in self.manifest(v)["current"].items()}
        for v in versions[:-keep]:  # readers of an old version lose its name before its files
            self.files.fs.delete(self.files.path(f"commits/{v:08d}.json"), False)
        for name in self.files.names("data"):
            if int(name.split("-")[0]) > versions[-1]:
                continue  # a writer's that isn't done
            for b in (int(n.split("=")[1]) for n in self.files.names(f"data/{name}") if n.startswith("bucket=")):
                if (name, b) not in used:
                    self.files.fs.delete(self.files.path(f"data/{name}/bucket={b}"), True)
                    gone += 1
        return gone


# ------------------------------------------------------------------ revisions


REVISION_COLUMNS = ("dialogue", "revision", "content_hash", "parser", "is_current", "body")


def revision_id(dialogue: Column, parser: Column, content_hash: Column) -> Column:
    """A revision is named by what it is a revision of, who parsed it, and what it holds, so a rerun names it alike."""
    return F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("\x00", dialogue.cast("string"), parser, content_hash), 256), 1, 24))


def write_revisions(table: CommitTable, batch: DataFrame, token: str) -> int:
    """batch(dialogue, parser, body) -> the version in which each of its dialogues has that body as current revision.

    ``table`` is keyed by dialogue and revision and bucketed by dialogue (see ``revision_table``).  A body that a dialogue had
    before is not stored again: its revision becomes current once more.  Dialogues outside the batch, and those
    whose current revision is the one given, stay as they are.  Of several bodies of a dialogue in one batch the greatest
    content hash counts; a NULL body is a body.
    """
    base = table.manifest()
    if base and token in base["tokens"]:
        return base["version"]
    hashed = F.sha2(F.coalesce(F.concat(F.lit("S"), F.col("body")), F.lit("N")), 256)
    new = batch.select("dialogue", "parser", "body", hashed.alias("content_hash"))
    new = new.withColumn("revision", revision_id(F.col("dialogue"), F.col("parser"), F.col("content_hash"))).withColumn("is_current", F.lit(True)).select(*REVISION_COLUMNS)
    chosen = F.max(F.struct("content_hash", "revision"))
    if base:
        # What changes is found without bodies.
        current = table.read(only=table.touched(batch)).filter("is_current").select("dialogue", "revision")
        given = new.groupBy("dialogue").agg(chosen.alias("r")).select("dialogue", "r.revision")
        touched = table.touched(given.alias("n").join(current.alias("c"), same_keys("n", "c", ["dialogue", "revision"]), "left_anti"))
        if not touched:
            return base["version"]
        rows = table.read(only=touched).select(*REVISION_COLUMNS).withColumn("_new", F.lit(False)).unionByName(new.filter(table.bucket().isin(touched)).withColumn("_new", F.lit(True)))
    else:
        touched, rows = table.touched(batch), new.withColumn("_new", F.lit(True))
    # Stored and new bodies meet in their bucket, where they are moved to once: a row a revision, then the one that its dialogue has now.
    pick = F.max(F.struct("_new", "content_hash", "parser", "is_current", "body")).alias("_row")
    one = table.dealt(rows, touched).groupBy("bucket", "dialogue", "revision").agg(pick, F.bool_or(~F.col("_new")).alias("_old"))
    one = one.select("bucket", "dialogue", "revision", "_row.*", "_old")
    now = F.max(F.when(F.col("_new"), F.struct("content_hash", "revision"))).over(W.partitionBy("bucket", "dialogue"))
    one = one.withColumn("_now", now["revision"]).filter(F.col("_old") | (F.col("revision") == F.col("_now")))
    one = one.withColumn("is_current", F.when(F.col("_now").isNull(), F.col("is_current")).otherwise(F.col("revision") == F.col("_now")))
    return table._commit(one.select(*REVISION_COLUMNS, "bucket"), touched, token, {}, base)


def revision_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> CommitTable:
    return CommitTable(spark, path, ["dialogue", "revision"], buckets, ["dialogue"])


def backfill(table: CommitTable, compute, group: list[str], version_column: str, version: int) -> int:
    """Computes stored columns anew where an older version of their operator wrote them; gives the table's version.

    ``compute`` maps whole groups of rows to the same rows with their new values.  Only groups with a row below ``version``
    (or without one) are read whole and written; if there is none, nothing is.
    """
    now = table.manifest()
    rows = table.read()
    old = settled(rows.filter(F.col(version_column).isNull() | (F.col(version_column) < version)).select(*group).distinct(), "outdated")
    if old.isEmpty():
        return now["version"]
    whole = rows.alias("r").join(old.alias("o"), same_keys("r", "o", group), "left_semi")
    fresh = compute(whole).withColumn(version_column, F.lit(version).cast(rows.schema[version_column].dataType)).select(*rows.columns)
    return table.merge(fresh, f"{version_column}-{version}-after-{now['version']}")


# ------------------------------------------------------------------ projections


def replace_projection(spark: SparkSession, path: str, rows: DataFrame, revisions: DataFrame, key: str = "revision", parts: int = BUCKETS) -> None:
    """Makes ``rows`` all that the projection at ``path`` has of ``revisions``(key): those without rows lose theirs.

    The projection is partitioned by a hash of the key.  Only partitions with such a revision are written; files of the
    others stay as they are.  A rerun writes the same rows again.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    given = settled(revisions.select(key).distinct(), "revisions")
    touched = sorted(r[0] for r in given.select(part).distinct().collect())  # ``parts`` rows at most
    if not touched:
        return
    new, files = rows.join(given, key, "left_semi").select(*rows.columns, part), Files(spark, path)
    if files.names():
        old = spark.read.schema(new.schema).option("basePath", path).parquet(path).filter(F.col("part").isin(touched))
        new = old.join(given, key, "left_anti").select(*new.columns).unionByName(new)
    new = settled(new, "projection")
    new.repartition(parts, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for p in set(touched) - {r[0] for r in new.select("part").distinct().collect()}:
        files.fs.delete(files.path(f"part={p}"), True)  # a dynamic overwrite leaves a partition that gets no rows
