"""State merges: presence, fingerprints, renames, queues, staleness, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def presence(before: Column, missed_scans: Column, limit: int) -> Column:
    """The next presence after complete scans that did (0) or didn't find a file."""
    return F.when(missed_scans == 0, "active").when(before == "deleted", "deleted").when(missed_scans < limit, "missing").otherwise("deleted")


def fingerprint_differs(old: str, new: str) -> Column:
    """By hash where both have one, else by size, then time, then head hash."""
    o, n = F.col(old), F.col(new)
    both = lambda f: o[f].isNotNull() & n[f].isNotNull()
    return (
        F.when(both("sha256"), o["sha256"] != n["sha256"]).when(o["size_bytes"] != n["size_bytes"], True).when(o["mtime_ms"] != n["mtime_ms"], True)
        .when(both("head_hash"), o["head_hash"] != n["head_hash"]).otherwise(False)
    )


def reconcile(previous: DataFrame, scanned: DataFrame, key: str, complete: bool, limit: int = 3) -> DataFrame:
    """previous(key, presence, missed, f) with scanned(key, f) -> action, presence and missed scans of each location.

    A scan that isn't complete never moves a location that it didn't see.
    """
    p = previous.select(key, F.col("presence").alias("was"), F.col("missed"), F.col("f").alias("old"))
    out = p.join(scanned.select(key, F.col("f").alias("new")), key, "full_outer")
    seen, known = F.col("new").isNotNull(), F.col("was").isNotNull()
    missed = F.when(seen, 0).otherwise(F.coalesce("missed", F.lit(0)) + (1 if complete else 0))
    action = (
        F.when(seen & ~known, "new").when(seen & (F.col("was") != "active"), "returned").when(seen & fingerprint_differs("old", "new"), "changed")
        .when(seen, "unchanged").when(F.lit(not complete), "unknown").otherwise("missing")
    )
    now = F.when(seen, "active").when(F.lit(not complete), F.col("was")).otherwise(presence(F.col("was"), missed, limit))
    return out.select(key, action.alias("action"), now.alias("presence"), missed.cast("int").alias("missed"))


def renames(missing: DataFrame, new: DataFrame, active: DataFrame) -> DataFrame:
    """missing(path, sha256) and new(path, sha256) with one candidate on each side and no active twin."""
    once = lambda df, name: df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("sha256"))).filter("_n = 1").select("sha256", F.col("path").alias(name))
    pairs = once(missing, "old_path").join(once(new, "new_path"), "sha256")
    return pairs.join(active.select("sha256").distinct(), "sha256", "left_anti")


def stale(pairs: list[tuple[str, str]]) -> Column:
    """Any recorded value differs from the present one; NULL equals NULL."""
    test = F.lit(False)
    for a, b in pairs:
        test = test | ~F.col(a).eqNullSafe(F.col(b))
    return test


def distribute(rows: DataFrame, key: str, order: str, weight: str, amount: int) -> DataFrame:
    """Splits a whole amount over the rows of a key by weight; the last row takes the remainder."""
    w = W.partitionBy(key)
    rows = rows.withColumn("_total", F.sum(weight).over(w)).filter("_total > 0")
    rows = rows.withColumn("_part", F.floor(F.lit(amount) * F.col(weight) / F.col("_total")))
    last = F.lead(order).over(w.orderBy(order)).isNull()
    return rows.withColumn("part", F.when(last, amount - (F.sum("_part").over(w) - F.col("_part"))).otherwise(F.col("_part")).cast("bigint")).drop("_total", "_part")


def lease(jobs: DataFrame, now_ms: int, limit: int, max_attempts: int = 8, expiry_ms: int = 300_000) -> DataFrame:
    """The next due jobs(id, status, created_at, attempts, not_before, locked_at), oldest first, with their new lease."""
    expired = (F.col("status") == "leased") & (F.col("locked_at") + expiry_ms <= now_ms)
    due = jobs.filter((((F.col("status") == "pending") & (F.coalesce("not_before", F.lit(0)) <= now_ms)) | expired) & (F.col("attempts") < max_attempts))
    return due.orderBy("created_at", "id").limit(limit).withColumns({"status": F.lit("leased"), "locked_at": F.lit(now_ms), "attempts": F.col("attempts") + 1})


def token_batches(items: DataFrame, key: str, order: str, tokens: str, most_items: int = 64, most_tokens: int = 300_000) -> DataFrame:
    """Greedy batches in order; an item over the bound stands alone.  Adds ``batch`` (from 0 in each key).

    A batch starts where the one before it ends, so a key's rows are walked in order by one task; they stream through it
    sorted, and only the open batch's count and sum are held.
    """

    def fold(frames):
        current, batch, n, total = None, 0, 0, 0
        for pdf in frames:
            out = []
            for k, t in zip(pdf[key], pdf[tokens], strict=True):
                if current is None or k != current[0]:
                    current, batch, n, total = (k,), 0, 0, 0
                elif n >= most_items or total + t > most_tokens:
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + t
                out.append(batch)
            yield pdf.assign(batch=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", batch bigint"
    return items.repartition(key).sortWithinPartitions(key, order).mapInPandas(fold, schema)


def stuck_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs(status, locked_until) that are leased past their time, with ``overdue_ms`` at ``now``; a lease without an end is stuck at once."""
    over = F.col("locked_until").isNull() | (F.col("locked_until") < now)
    late = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("locked_until").cast("timestamp"))
    return jobs.filter((F.col("status") == "leased") & over).withColumn("overdue_ms", late)


def first_copies(files: DataFrame, order: list[str]) -> DataFrame:
    """files(root, path, device, inode, sha256, ...) without those that another root holds already.

    A file is a copy of the first, by ``order``, that has its device and inode, or of the first with its SHA-256; the two are
    asked in turn, so a file that is dropped for its place on disk doesn't stand for its content.  Unknown identities and
    digests are nobody's.  Only the first of each is looked up, so a file with any number of copies costs one row a task.
    """
    rows, place = files, F.struct(*order)
    for keys in (["device", "inode"], ["sha256"]):
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        first = rows.filter(known).groupBy(*keys).agg(F.min(F.struct(place.alias("place"), F.col("root").alias("root"))).alias("_first"))
        rows = rows.join(first, keys, "left").filter(~known | (F.col("_first.root") == F.col("root"))).drop("_first").select(*files.columns)
    return rows
