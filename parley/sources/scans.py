"""Listings of source roots that say whether they are complete.

A root is ``complete``, ``partial`` (some folder or file in it couldn't be read), ``unavailable`` (it isn't there),
``permission_denied`` or ``failed``.  Links and resource forks are left out.  Roots that every executor can open are listed
by a data source whose partitions are the folders right under a root, so a large root is listed by many tasks; roots in a
store that only Spark reaches are listed through it, folder by folder.
"""

from __future__ import annotations

import errno
import json
import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCAN = "root string, relative_path string, size_bytes bigint, mtime_ms bigint, error string, is_root boolean"
_CODES = {errno.EACCES: "permission_denied", errno.EPERM: "permission_denied", errno.ENOENT: "unavailable", errno.ENOTDIR: "unavailable"}


def status_of(error: OSError) -> str:
    return _CODES.get(error.errno, "failed")


def entries(folder: str):
    """(name, is a folder, is a file) of what a folder holds, without links."""
    with os.scandir(folder) as found:
        return sorted((e.name, e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)) for e in found if not e.is_symlink())


def walk(root: str, below: str = "", list_=entries, stat_=os.stat, deep: bool = True):
    """Rows of SCAN for what lies under ``root``/``below``: files, and what couldn't be read (the folder itself as the root's)."""
    folder = os.path.join(root, below) if below else root
    try:
        found = list_(folder)
    except OSError as e:
        yield root, below or None, None, None, status_of(e), not below
        return
    for name, is_folder, is_file in found:
        path = f"{below}/{name}" if below else name
        if is_folder:
            if deep:
                yield from walk(root, path, list_, stat_)
        elif is_file and not name.startswith("._"):
            try:
                s = stat_(os.path.join(root, path))
                yield root, path, s.st_size, s.st_mtime_ns // 1_000_000, None, False
            except OSError as e:
                yield root, path, None, None, status_of(e), False


class Part(InputPartition):
    """A root's own files (below is empty), a folder right under it, or the error of a root."""

    def __init__(self, root: str, below: str = "", error: str | None = None, single: bool = False):
        self.root, self.below, self.error, self.single = root, below, error, single


class ScanReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self):
        out = []
        for root in self.roots:
            try:
                if not stat.S_ISDIR(os.stat(root).st_mode):  # a root may be a link itself
                    out.append(Part(root, single=True))
                    continue
                out.append(Part(root))
                out += [Part(root, name) for name, is_folder, _ in entries(root) if is_folder]
            except OSError as e:
                out = [p for p in out if p.root != root] + [Part(root, error=status_of(e))]
        return out or [Part("", error="none")]

    def read(self, partition: Part):
        if partition.error == "none":
            return
        if partition.error:
            yield partition.root, None, None, None, partition.error, True
        elif partition.single:
            s = os.stat(partition.root)
            if stat.S_ISREG(s.st_mode):
                yield partition.root, os.path.basename(partition.root), s.st_size, s.st_mtime_ns // 1_000_000, None, False
        else:
            yield from walk(partition.root, partition.below, deep=bool(partition.below))


class DirectoryScan(DataSource):
    """``spark.read.format("directory_scan").option("roots", <JSON list of folders>)``."""

    @classmethod
    def name(cls):
        return "directory_scan"

    def schema(self):
        return SCAN

    def reader(self, schema):
        return ScanReader(json.loads(self.options["roots"]))


def remote_rows(spark: SparkSession, root: str):
    """The same rows through Spark's file systems, for a root that Python can't open."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def error_of(e: Exception) -> str:
        text = str(e)
        return "unavailable" if "FileNotFound" in text else "permission_denied" if "AccessControl" in text or "Permission denied" in text else "failed"

    waiting = [""]
    while waiting:
        below = waiting.pop()
        try:
            found = fs.listStatus(jvm.org.apache.hadoop.fs.Path(at, below) if below else at)
        except Exception as e:  # noqa: BLE001
            yield root, below or None, None, None, error_of(e), not below
            continue
        for s in found:
            name = s.getPath().getName()
            path = f"{below}/{name}" if below else name
            if s.isDirectory():
                waiting.append(path)
            elif s.isFile() and not name.startswith("._"):
                yield root, path, s.getLen(), s.getModificationTime(), None, False


def scan_roots(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(status(root, status, n_files, n_errors), one row a root; files(root, relative_path, size_bytes, mtime_ms))."""
    local = {r: r.removeprefix("file://") for r in roots if "://" not in r or r.startswith("file://")}
    spark.dataSource.register(DirectoryScan)
    rows = spark.read.format("directory_scan").option("roots", json.dumps(sorted(set(local.values())))).load()
    for r in roots:
        if r not in local:
            rows = rows.unionByName(spark.createDataFrame(list(remote_rows(spark, r)), SCAN))
    names = spark.createDataFrame([(r, local.get(r, r)) for r in dict.fromkeys(roots)], "name string, root string")
    rows = names.join(rows, "root", "left")
    whole = F.max(F.when(F.col("is_root"), F.col("error")))
    n_files = F.count(F.when(F.col("relative_path").isNotNull() & F.col("error").isNull(), 1))
    g = rows.groupBy("name").agg(whole.alias("whole"), n_files.alias("n_files"), F.count("error").alias("n_errors"))
    status = g.select(F.col("name").alias("root"), F.coalesce("whole", F.when(F.col("n_errors") > 0, "partial").otherwise("complete")).alias("status"), F.when(F.col("whole").isNull(), F.col("n_files")).otherwise(0).alias("n_files"), "n_errors")
    files = rows.filter("relative_path is not null and error is null").select(F.col("name").alias("root"), "relative_path", "size_bytes", "mtime_ms")
    return status, files
