"""Presence of source files over a stream of scans, as a state machine that Spark keeps.

A scan that sees a file makes it active.  A complete scan that doesn't see it makes it missing, and deleted after
``confirmations`` such scans in a row.  A scan that isn't complete never advances a file that it didn't see.  State is kept
for each root and part of its paths, an entry a file, so no task holds a root.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PARTS, CONFIRMATIONS = 16, 3
OUT = "root string, scan bigint, path string, action string, presence string, missed int, fingerprint string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_parts(scans: DataFrame, parts: int = PARTS) -> DataFrame:
    """scans(root, scan, complete, path, fingerprint), one row without a path for each scan -> the same by part; the row of a
    scan goes to every part, so that parts which saw nothing know of it."""
    own = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")
    every = F.array(*(F.lit(i) for i in range(parts)))
    return scans.withColumn("part", F.explode(F.when(F.col("path").isNull(), every).otherwise(F.array(own))))


class Presence(StatefulProcessor):
    def __init__(self, confirmations: int = CONFIRMATIONS):
        self.confirmations = max(1, confirmations)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "presence string, missed int, fingerprint string, scan bigint")
        self.last = handle.getValueState("last", "scan bigint")

    def handleInputRows(self, key, rows, timerValues):
        found = pd.concat(list(rows), ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else -1
        for scan, own in found.groupby("scan", sort=True):
            if scan <= last:
                continue  # known already: a scan that is sent again changes nothing
            out = []
            for path, fingerprint in own[own["path"].notna()].drop_duplicates("path")[["path", "fingerprint"]].itertuples(index=False):
                was = self.files.getValue((path,)) if self.files.containsKey((path,)) else None
                action = "new" if was is None else "returned" if was[0] != "active" else "unchanged" if was[2] == fingerprint else "changed"
                self.files.updateValue((path,), ("active", 0, fingerprint, int(scan)))
                out.append((key[0], scan, path, action, "active", 0, fingerprint))
            if bool(own["complete"].iloc[0]):
                unseen = [(k[0], v) for k, v in self.files.iterator() if v[3] != scan]
                for path, (_, missed, fingerprint, at) in unseen:
                    now = ("deleted" if missed + 1 >= self.confirmations else "missing", missed + 1)
                    self.files.updateValue((path,), (*now, fingerprint, at))
                    out.append((key[0], scan, path, "missing", *now, fingerprint))
            last = int(scan)
            yield pd.DataFrame(out, columns=["root", "scan", "path", "action", "presence", "missed", "fingerprint"])
        self.last.update((last,))

    def close(self) -> None:
        pass


def track(scans: DataFrame, confirmations: int = CONFIRMATIONS, parts: int = PARTS) -> DataFrame:
    """A stream of scans -> a stream of what each did to each file that it moved or saw."""
    rows = in_parts(scans, parts).groupBy("root", "part")
    return rows.transformWithStateInPandas(Presence(confirmations), OUT, "append", "none")


def run_presence(spark, source: str, target: str, state: str, confirmations: int = CONFIRMATIONS) -> None:
    """Takes the scans that arrived at ``source`` since the last call; results are added to ``target``."""
    schema = "root string, scan bigint, complete boolean, path string, fingerprint string"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)  # the one that keeps maps
    try:
        stream = spark.readStream.schema(schema).parquet(source)
        track(stream, confirmations).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def present(moves: DataFrame) -> DataFrame:
    """(root, path, presence, missed, fingerprint): where each file stands after its last move."""
    last = F.max_by(F.struct("presence", "missed", "fingerprint"), "scan").alias("m")
    return moves.groupBy("root", "path").agg(last).select("root", "path", "m.*")
