"""Near duplicates by min-max hashing: sets of word shingles, banded by the least and the greatest value of each permutation.

A document's set holds its distinct shingles of ``words`` words (fewer words: the whole sequence).  Each permutation of the
hashed shingles gives two values of a signature, its minimum and its maximum, so a signature of 276 values takes 138 hash
evaluations a shingle.  Either value is equal in two sets with a probability of their Jaccard index.  The two are never equal
for different reasons more often than independent ones would be, so they estimate it without bias and with less variance;
for bands that means fewer misses.  A band takes ``band`` minima, or the maxima of the same permutations, and there are as
many as miss a pair at the wanted index with a probability of ``missed``.

Equal sets are one node, whatever their number.  Sets that meet in a band are first compared with the smallest node of it.
If its links don't join a band's sets into one group, those of different groups are compared too: they are cut into blocks of
sets of like size and the pairs of blocks that meet in a band are counted whole.  So every candidate pair that could still
join two groups is judged on its full sets, no row is made for each pair, and nothing is dropped.

Null, empty and wordless texts have an empty set, which links with nothing.  Rows that repeat, and equal texts, are in one
group.  A null doc_id never names a group; a document without id is kept only if no document with an id is in its group.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, bounded_batches, fixed_multipliers, materialize, mix64, utf8
from parley.llm.components import connected_components
from parley.llm.near_copies import NO_ID, are_alike, block_links

WORDS = 2
#: The Jaccard index at which sets link, as a fraction; ``are_alike`` and ``block_links`` judge by the same.
ALIKE = (4, 5)
#: Values in a band, and the share of pairs at ALIKE that may meet in none.
BAND, MISSED = 6, 1e-6
#: Shingles of a block of sets that are counted together, about, and what a set adds to its own.
BLOCK_SHINGLES, SET_WEIGHT = 40_000, 100
SEED = 42


def bands_for(alike: tuple[int, int] = ALIKE, band: int = BAND, missed: float = MISSED) -> int:
    """How many bands miss a pair at ``alike`` with a probability of ``missed``: an even number, half of minima, half of maxima."""
    n = math.ceil(math.log(missed) / math.log1p(-((alike[0] / alike[1]) ** band)))
    return n + n % 2


# ------------------------------------------------------------------ sets and signatures


def hashed_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, hashed to 64 bits and sorted."""
    raw, at, _ = utf8(column)
    data = raw.tobytes().lower()  # A-Z only
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    codes = []
    for i in range(len(at) - 1):
        own = data[at[i] : at[i + 1]].split()
        codes.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
    digest = xxhash.xxh64_intdigest
    word = np.fromiter((digest(w, SEED) for w in number), np.uint64, len(number))
    keys, out = fixed_multipliers(words + 1, 31), []
    for own in codes:
        h, k = word[own], min(len(own), words)
        n = len(h) - k + 1 if k else 0
        with np.errstate(over="ignore"):
            x = np.full(n, keys[words] * np.uint64(k), np.uint64)
            for j in range(k):
                x += h[j : j + n] * keys[j]
        out.append(np.unique(mix64(x)))
    return out


def signatures(sets: list[np.ndarray], permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima) of each set under each permutation; those of an empty set mean nothing."""
    keys = (fixed_multipliers(permutations, 37) >> np.uint64(13)).astype(np.uint32) | np.uint32(1)
    low = np.full((len(sets), permutations), np.iinfo(np.uint32).max, np.uint32)
    high = np.zeros((len(sets), permutations), np.uint32)
    for i, s in enumerate(sets):
        s = s.astype(np.uint32)
        for a in range(0, len(s), 512):
            h = keys[:, None] * s[None, a : a + 512]
            np.minimum(low[i], h.min(axis=1), out=low[i])
            np.maximum(high[i], h.max(axis=1), out=high[i])
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, band: int) -> np.ndarray:
    """One 64-bit key for each set and band; keys of different bands don't meet."""
    keys, cols = fixed_multipliers(band + 1, 41), []
    for side, values in enumerate((low, high)):
        for g in range(values.shape[1] // band):
            with np.errstate(over="ignore"):
                x = np.full(len(values), np.uint64(2 * g + side + 1) * keys[band], np.uint64)
                for j in range(band):
                    x += values[:, g * band + j].astype(np.uint64) * keys[j]
            cols.append(mix64(x))
    return np.stack(cols, axis=1)


def min_max_bands(words: int, band: int, bands: int):
    @arrow_function("struct<node:bigint,n:bigint,bands:array<bigint>>")
    def prints(text: pa.Array) -> pa.Array:
        sets = hashed_sets(text, words)
        keys = band_keys(*signatures(sets, bands // 2 * band), band)
        node = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
        at = pa.array((np.arange(len(sets) + 1) * bands).astype(np.int32))
        cols = [pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))]
        return pa.StructArray.from_arrays(cols, ["node", "n", "bands"])

    return prints


def set_bytes(words: int):
    @arrow_function("binary")
    def sets(text: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for s in hashed_sets(text, words)], pa.binary())

    return sets


# ------------------------------------------------------------------ links


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (the greatest number for a null one), content, text: together the first two name a text."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "text")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, name: str) -> DataFrame:
    """(node, s) of the wanted nodes, from one text of each."""
    names = nodes.join(wanted, "node", "left_semi").select("doc_id", "content", "node")
    texts = keyed(docs).join(names, ["doc_id", "content"]).select("node", set_bytes(words)("text").alias("s"))
    return materialize(texts.dropDuplicates(["node"]), name)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose full sets are alike; sizes alone rule most others out."""
    left = pairs.join(sets.select(F.col("node").alias("src"), F.col("s").alias("a")), "src")
    both = left.join(sets.select(F.col("node").alias("dst"), F.col("s").alias("b")), "dst")
    sized = both.filter(ALIKE[1] * F.least(F.length("a"), F.length("b")) >= ALIKE[0] * F.greatest(F.length("a"), F.length("b")))
    return materialize(sized.filter(are_alike("a", "b")).select("src", "dst"), "min-max-links")


def open_bands(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the bands whose sets, besides the smallest, are in more than one group."""
    rooted = met.filter("node <> hub").select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = materialize(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"), "open-keys")
    return materialize(rooted.join(mixed, "key", "left_semi"), "open-rows")


def block_pairs(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) of blocks that meet in an open band, fit in size and don't hold one group only.

    rows(key, node, root); blocks(node, block, size).  A band has a row for each of its blocks here, not for its sets.
    """
    own = rows.join(blocks.select("node", "block", "size"), "node").groupBy("key", "block", "size").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    own = materialize(own, "band-blocks")
    other = own.select("key", *(F.col(c).alias(f"{c}_b") for c in ("block", "size", "lo", "hi")))
    both = own.join(other, "key").filter("block <= block_b and abs(size - size_b) <= 1 and not (lo = hi and lo_b = hi_b and lo = lo_b)")
    return materialize(both.select(F.col("block").alias("a"), F.col("block_b").alias("b")).distinct(), "block-pairs")


def set_groups(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """nodes(node, n, doc_id, content, bands), one row a set -> (node, root) of those that a link reaches."""
    spark = nodes.sparkSession
    rows = nodes.select("node", F.explode("bands").alias("key"))
    # Most keys have one set.  Minima are taken before the shuffle, so a band of any size sends one row a task.
    shared = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").select("key", "hub")
    met = materialize(rows.join(materialize(shared, "shared-keys"), "key"), "met")
    first = materialize(met.filter("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct(), "first-pairs")
    sets = sets_of(first.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), nodes, docs, words, "first-sets")
    links = verified(first, sets)
    roots = materialize(connected_components(links, "src", "dst"), "first-roots")
    rows = open_bands(met, roots)
    if rows.isEmpty():
        return roots
    # The first pairs connect what all candidates connect; a block holds sets of one such group and of like size.
    groups = connected_components(first, "src", "dst").select("node", F.col("root").alias("grp"))
    members = rows.select("node", "root").distinct().join(groups, "node").join(nodes.select("node", "n"), "node")
    members = materialize(members.withColumn("size", F.floor(F.log("n") / math.log(ALIKE[1] / ALIKE[0])).cast("int")), "members")
    counts = members.groupBy("grp", "size").agg(F.ceil(F.sum(F.col("n") + SET_WEIGHT) / BLOCK_SHINGLES).alias("blocks"))
    block = F.xxhash64("grp", "size", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = materialize(members.join(counts, ["grp", "size"]).select("node", "root", "size", block.alias("block")), "blocked")
    pairs = block_pairs(rows, members)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("block")).distinct()
    held = members.join(wanted, "block", "left_semi").join(sets, "node")
    held = materialize(held.groupBy("block").agg(F.collect_list(F.struct("node", "root", "s")).alias("rows")), "blocks")
    both = pairs.join(held.select(F.col("block").alias("a"), F.col("rows").alias("left")), "a").join(held.select(F.col("block").alias("b"), F.col("rows").alias("right")), "b")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    more = both.select("left", "right").repartition(parts).mapInArrow(block_links, "src bigint, dst bigint")
    return connected_components(materialize(links.unionByName(more), "all-links"), "src", "dst")


def near_groups(docs: DataFrame, words: int = WORDS, band: int = BAND, missed: float = MISSED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, content (a hash of the text), n_shingles, component_id: one row a row."""
    bounded_batches(docs.sparkSession)
    bands = bands_for(ALIKE, band, missed)
    prints = keyed(docs).select("doc_id", "content", min_max_bands(words, band, bands)("text").alias("s"))
    prints = materialize(prints.select("doc_id", "content", "s.*"), "min-max")
    some = prints.filter("n > 0")
    nodes = some.groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("node", "n", "k.*", "bands"), "sets")
    own = nodes.select("node", "doc_id").join(set_groups(nodes, docs, words), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = own.join(least, "root").select("node", "component_id")
    found = some.select("doc_id", "content", "node", "n").join(named, "node").select("doc_id", "content", "n", "component_id")
    found = found.unionByName(prints.filter("n = 0").select("doc_id", "content", "n", F.col("doc_id").alias("component_id")))
    given = {c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("doc_id", "component_id")}
    return found.withColumns(given).select("doc_id", "content", F.col("n").alias("n_shingles"), "component_id")


def op11_minmax(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 2-word shingles, its component and whether it is the one that stays."""
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
