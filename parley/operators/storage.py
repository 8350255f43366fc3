"""Shared paths, atomic publication of small files, and rows in the order in which files hold them."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_A_PART = 200_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: ``spark.checkpoint.dir``, or a new one on a local master without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parley-tables-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/parley/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it: cuts lineage, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Work:
    """Tables that one job writes on its way.  Each goes when it is dropped, and all go at the end of the block, so a job holds what it still reads.

    ``placed`` writes rows by the hash of a column into ``parts`` buckets, and reads them back so: what joins, groups or
    orders rows within that column then moves none.
    """

    def __init__(self, spark: SparkSession, parts: int):
        self.spark, self.parts = spark, parts
        self._paths: dict[str, str] = {}
        self._tables: dict[str, str] = {}

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *failed) -> None:
        self.drop(*list(self._paths))

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        path = self._paths[name] = shared_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def placed(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """Rows stay in the task that they are in; a bucket has a file of each task that has rows of it."""
        path = self._paths[name] = shared_path(self.spark, name)
        table = self._tables[name] = f"parley_work_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").bucketBy(self.parts, column).option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if table := self._tables.pop(name, None):
                self.spark.sql(f"drop table if exists {table}")  # external: files stay
            if path := self._paths.pop(name, None):
                files = Files(self.spark, path)
                files.fs.delete(files.root, True)


def parts_of(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows: some ``ROWS_A_PART`` each, and work for all cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_PART), 1)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Holds a setting of the session at a value, and puts back what was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Files:
    """The file system behind a path, through Hadoop, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.hadoop = self.jvm.org.apache.hadoop
        self.root = self.hadoop.fs.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(conf)
        self.context = self.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.hadoop.fs.Path(self.root, name) if name else self.root

    def names(self, name: str = "") -> list[str]:
        """Sorted names of what a folder holds; none if it isn't there."""
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Makes a file appear whole under its name; False if the name is taken.  Of two writers one succeeds."""
        draft = self.path(f".draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.context.rename(draft, self.path(name), none)
        except Exception as e:  # noqa: BLE001
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


def place() -> tuple[Column, Column, Column]:
    """Where a row of a Spark-written dataset stands: the number in its file's name, the name, and its number in the file."""
    name = F.col("_metadata.file_name")
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("int").alias("_part"), name.alias("_file"), F.col("_metadata.row_index").alias("_row")


def numbered(spark: SparkSession, path: str, columns: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rows of a dataset with their place in it, from 0: files are counted, not sorted, so nothing is moved.

    Only one row a file meets in one task, for the running total.
    """
    rows = spark.read.parquet(path)
    rows = rows.select(*(columns or rows.columns), *place())
    sizes = spark.read.parquet(path).select(*place()).groupBy("_part", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.selectExpr("_part", "_file", "sum(_n) over (order by _part, _file rows between unbounded preceding and current row) - _n as _before")
    joined = rows.join(before.drop("_part"), "_file")
    return joined.withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_file", "_row", "_before")
