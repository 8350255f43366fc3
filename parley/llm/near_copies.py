"""Near-duplicate removal: SimHash candidates by generalised pigeonhole, verified by exact shingle similarity.

Near copies are texts whose distinct 5-word shingles have a Jaccard index of 0.8 or more.  A 64-bit fingerprint of such
a pair differs in some 15 % of its bits, too many for one narrow radius, so a text gets ``PRINTS`` independent
fingerprints of its distinct shingles.  Each is searched by the pigeonhole plan of ``simhash`` at ``RADIUS``; whatever
meets in a bucket of any fingerprint and is within ``WIDE`` bits on two of them is a candidate.  Candidates are verified
by counting the shingles of both whole texts, so no pair under 0.8 links by itself; links chain into groups.

Equal sets of shingles are one node whatever their number.  A group first sends candidates that just connect it.  Where
their verified links don't join it again, its sets get sketches that part most pairs under 0.8 in the buckets, it is cut
into blocks of some ``BLOCK_SHINGLES`` shingles, and the pairs of blocks that candidates of different parts lie in are
counted whole, as matrix products.  So no group sends a row for each of its pairs.  In such an open group a candidate goes
unjudged if its sketches differ by more than ``SKETCH_RADIUS`` bits, which happens to some 0.05 % of pairs at 0.8 and to fewer
above; all other candidates are judged on their whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, bounded_batches, fixed_multipliers, free_name, materialize, mix64, utf8
from parley.llm.components import connected_components, star_edges
from parley.llm.simhash import BLOCK, PROBE, SEED, Near, batch_words, bit_counts, bucket_links, in_buckets, large_buckets, majority, plan_for, probe_rows, shingle_hashes, small_pairs, whole_buckets

#: Near copies share this part of the distinct 5-word shingles of both texts (Jaccard), as a fraction.
ALIKE = (4, 5)
#: Independent fingerprints, the radius that each is searched at, and the most bits that candidates differ by in two of them.
PRINTS, RADIUS, WIDE = 3, 8, 18
#: Bits of a sketch of a set, each the last of a minimal hash, so that two sets differ in (1 - J) / 2 of them; and the most
#: that a pair at 0.8 differs in: its mean of 51.2 and 3.3 standard deviations more.
SKETCH, SKETCH_RADIUS = 512, 74
#: Shingles of a block of nodes that are counted together, about, and what a node adds to its own.
BLOCK_SHINGLES, NODE_WEIGHT = 40_000, 100
NO_ID = (1 << 63) - 1
_KEYS = fixed_multipliers(PRINTS, 71)
_SKETCH_KEYS = fixed_multipliers(SKETCH, 73).astype(np.uint32) | np.uint32(1)


def copy_shingles(words: list[bytes]) -> np.ndarray:
    """The distinct 5-word shingles, sorted."""
    return np.unique(shingle_hashes(words, 5))


PRINTED = "struct<node:bigint,n:int," + ",".join(f"p{j}:bigint" for j in range(PRINTS)) + ">"


@arrow_function(PRINTED)
def copy_prints(text: pa.Array) -> pa.Array:
    """Name and size of a text's set of shingles, and its fingerprints; those of an empty set are zero."""
    sets = [copy_shingles(w) for w in batch_words(text)]
    node = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
    n = np.array([len(s) for s in sets], np.int64)
    at, flat = np.concatenate(([0], np.cumsum(n))), np.concatenate([*sets, np.zeros(0, np.uint64)])
    cols = [pa.array(node.view(np.int64)), pa.array(n.astype(np.int32))]
    for j in range(PRINTS):
        h = mix64(flat ^ _KEYS[j])
        cols.append(pa.array(majority(bit_counts(h, at), n).view(np.int64)))
    return pa.StructArray.from_arrays(cols, ["node", "n", *(f"p{j}" for j in range(PRINTS))])


def sketch_of(s: np.ndarray) -> bytes:
    h, low = mix64(s).astype(np.uint32), np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(h), 512):
        np.minimum(low, (_SKETCH_KEYS[:, None] * h[None, a : a + 512]).min(axis=1), out=low)
    return np.packbits((mix64(low) & np.uint64(1)).astype(np.uint8)).tobytes()


@arrow_function("binary")
def set_sketch(sets: pa.Array) -> pa.Array:
    return pa.array([sketch_of(np.frombuffer(x.as_buffer(), "<u8")) for x in sets], pa.binary())


@arrow_function("binary")
def shingle_set(text: pa.Array) -> pa.Array:
    return pa.array([copy_shingles(w).tobytes() for w in batch_words(text)], pa.binary())


@arrow_function("boolean")
def are_alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """The exact test: shared shingles over all shingles of both texts."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
        both = np.sort(np.concatenate([x, y]), kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        out.append(ALIKE[1] * shared >= ALIKE[0] * (len(both) - shared))
    return pa.array(out, pa.bool_())


def _edges(a: list[np.ndarray], b: list[np.ndarray]):
    a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    for k in range(0, len(pairs), 1 << 16):
        part = pairs[k : k + (1 << 16)]
        yield pa.record_batch([pa.array(np.ascontiguousarray(part[:, 0])), pa.array(np.ascontiguousarray(part[:, 1]))], ["src", "dst"])


def firsts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs (x[i], y[i]): the first of each x and of each y."""
    return np.union1d(np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1])


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few of the pairs that connect what all of them connect."""
    some = firsts(x, y)
    while True:
        node, root = star_edges(x[some], y[some])
        order = np.argsort(node)
        node, root = node[order], root[order]

        def label(v, node=node, root=root):
            at = np.minimum(np.searchsorted(node, v), max(len(node) - 1, 0))
            return np.where(node[at] == v, root[at], v) if len(node) else v

        a, b = label(x), label(y)
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return x[some], y[some]
        some = np.union1d(some, apart[firsts(a[apart], b[apart])])


def first_pairs(batches):
    """Rows sorted by (slot, key) -> some of the candidates, which connect what all candidates connect."""
    for rows, cut in whole_buckets(batches):
        side, node, fp, check = (rows.column(c).to_numpy() for c in ("side", "node", "fp", "check"))
        near, a, b = Near([fp, check], WIDE), [], []
        for at in large_buckets(cut):
            for x, y in bucket_links(node[at], near.take(at)):
                x, y = spanning(x, y)
                a.append(x)
                b.append(y)
        for x, y in small_pairs(cut, side, near):
            x, y = spanning(node[x], node[y])
            a.append(x)
            b.append(y)
        yield from _edges(a, b)


def crossing_blocks(batches):
    """The same rows with ``root``, ``block`` and ``sketch`` -> the pairs of blocks that candidates of different roots lie in."""
    for rows, cut in whole_buckets(batches):
        side, node, fp, check, root, block = (rows.column(c).to_numpy() for c in ("side", "node", "fp", "check", "root", "block"))
        sketch = np.frombuffer(utf8(rows.column("sketch"))[0].tobytes(), "<u8").reshape(len(node), -1)
        near = Near([fp, check], WIDE, sketch, SKETCH_RADIUS)
        pairs = [np.zeros((0, 2), np.int64)]
        for at in large_buckets(cut):
            _, first = np.unique(node[at], return_index=True)
            own = at[first]
            if (root[own] == root[own[0]]).all():
                continue
            step = max(1, BLOCK // len(own))
            for k in range(0, len(own), step):
                r, c = near.grid(own[k : k + step], own[k:])
                x, y = own[k : k + step][r], own[k:][c]
                ok = root[x] != root[y]
                pairs.append(np.unique(np.sort(np.stack([block[x[ok]], block[y[ok]]], axis=1), axis=1), axis=0))
        for x, y in small_pairs(cut, side, near):
            ok = root[x] != root[y]
            pairs.append(np.unique(np.sort(np.stack([block[x[ok]], block[y[ok]]], axis=1), axis=1), axis=0))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        if len(pairs):
            yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])


def alike_in_blocks(left: list[dict], right: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of two blocks, with different roots, that are alike: counted by one matrix product."""
    if not left or not right:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def parts(rows):
        sets = [np.frombuffer(r["s"], "<u8") for r in rows]
        n = np.array([len(x) for x in sets], np.int64)
        return np.concatenate(sets), np.repeat(np.arange(len(rows)), n), n, np.array([r["node"] for r in rows], np.int64), np.array([r["root"] for r in rows], np.int64)

    (x, xi, xn, xnode, xroot), (y, yi, yn, ynode, yroot) = parts(left), parts(right)
    # Only shingles of both blocks count.
    common = np.intersect1d(x, y)
    shared = np.zeros((len(xn), len(yn)), np.float32)
    for k in range(0, len(common), 1 << 14):
        own = common[k : k + (1 << 14)]
        pair = []
        for v, i, n in ((x, xi, len(xn)), (y, yi, len(yn))):
            at = np.minimum(np.searchsorted(own, v), len(own) - 1)
            hit = own[at] == v
            m = np.zeros((n, len(own)), np.float32)
            m[i[hit], at[hit]] = 1
            pair.append(m)
        shared += pair[0] @ pair[1].T
    shared = shared.astype(np.int64)
    ok = (ALIKE[1] * shared >= ALIKE[0] * (xn[:, None] + yn[None, :] - shared)) & (xroot[:, None] != yroot[None, :])
    i, j = np.nonzero(ok)
    return xnode[i], ynode[j]


def block_links(batches):
    """(left, right: the nodes of two blocks) -> links."""
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = alike_in_blocks(batch.column("left")[k].as_py(), batch.column("right")[k].as_py())
            if len(a):
                a, b = spanning(a, b)
                yield from _edges([a], [b])


def shingle_sets(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, s) of the wanted nodes; texts(node, text) may hold a node more than once."""
    return texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", shingle_set("text").alias("s"))


def alike_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose texts are alike."""
    wanted = materialize(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "pair-nodes")
    sets = materialize(shingle_sets(wanted, texts), "pair-sets")
    left = pairs.join(sets.select(F.col("node").alias("src"), F.col("s").alias("a")), "src")
    both = left.join(sets.select(F.col("node").alias("dst"), F.col("s").alias("b")), "dst")
    return materialize(both.filter(are_alike("a", "b")).select("src", "dst"), "pair-links")


def bucket_rows(nodes: DataFrame, plans: list, carried: tuple[str, ...] = ()) -> DataFrame:
    """nodes(node, p0, p1, ..., *carried) in the buckets of all fingerprints; each row has the next fingerprint as ``check``."""
    out = None
    for j, plan in enumerate(plans):
        own = nodes.select("node", F.col(f"p{j}").alias("fp"), F.col(f"p{(j + 1) % PRINTS}").alias("check"), *carried)
        rows = own.mapInArrow(probe_rows(plan, "fp", ("check", *carried), 64 * j), f"{PROBE}, check bigint" + "".join(f", {c} {'binary' if c == 'sketch' else 'bigint'}" for c in carried))
        out = rows if out is None else out.unionByName(rows)
    return in_buckets(out)


def copy_components(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes(node, n, p0, p1, ...), one row a node -> (node, root) of the nodes that a link reaches."""
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    n, link = nodes.count(), "src bigint, dst bigint"
    plans = [plan_for(nodes, f"p{j}", n, RADIUS) for j in range(PRINTS)]
    first = materialize(bucket_rows(nodes, plans).mapInArrow(first_pairs, link).distinct(), "first-pairs")
    links = alike_links(first, texts)
    roots = connected_components(links, "src", "dst")
    # The first pairs connect what all candidates connect: a group that their links join again is done.
    groups = connected_components(first, "src", "dst").select("node", F.col("root").alias("grp"))
    members = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(nodes, "node")
    members = materialize(members, "members")
    own = members.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.col("n") + NODE_WEIGHT).alias("n")).filter("lo <> hi")
    own = own.select("grp", F.ceil(F.col("n") / BLOCK_SHINGLES).alias("blocks"))
    block = F.xxhash64("grp", F.pmod(F.xxhash64("node"), F.col("blocks")))
    open_ = members.join(own, "grp").withColumn("block", block).drop("grp", "blocks", "n")
    sets = materialize(shingle_sets(open_.select("node"), texts).withColumn("sketch", set_sketch("s")), "open-sets")
    open_ = materialize(open_.join(sets.select("node", "sketch"), "node"), "open")
    if open_.isEmpty():
        return roots
    pairs = materialize(bucket_rows(open_, plans, ("root", "block", "sketch")).mapInArrow(crossing_blocks, "a bigint, b bigint").distinct(), "block-pairs")
    if pairs.isEmpty():
        return roots
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("block")).distinct()
    sets = sets.select("node", "s").join(open_.join(wanted, "block", "left_semi").select("node", "root", "block"), "node")
    blocks = materialize(sets.groupBy("block").agg(F.collect_list(F.struct("node", "root", "s")).alias("rows")), "blocks")
    both = pairs.join(blocks.select(F.col("block").alias("a"), F.col("rows").alias("left")), "a").join(blocks.select(F.col("block").alias("b"), F.col("rows").alias("right")), "b")
    more = both.select("left", "right").repartition(parts).mapInArrow(block_links, link)
    return connected_components(materialize(links.unionByName(more), "all-links"), "src", "dst")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.  Columns stay as they are.

    Texts without words are copies of each other.  Of rows that repeat whole (same doc_id and text) one stays.  A null
    doc_id is the largest.
    """
    bounded_batches(docs.sparkSession)
    prints = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), copy_prints("text").alias("s"))
    prints = prints.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "content", "s.*")
    prints = materialize(prints, "prints")
    nodes = materialize(prints.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), *(F.first(f"p{j}").alias(f"p{j}") for j in range(PRINTS))), "nodes")
    names = materialize(prints.groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("k")).select("node", "k.*"), "names")
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "text")
    texts = texts.join(names, ["doc_id", "content"]).select("node", "text")
    roots = copy_components(nodes, texts)
    groups = prints.select("doc_id", "content", "node").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = groups.agg(F.min(F.struct("doc_id", "content")).alias("k"), F.count(F.lit(1)).alias("n")).select("k.*")
    kept = materialize(kept, "kept")
    repeats = prints.join(kept, ["doc_id", "content"], "left_semi").groupBy("doc_id", "content").count().filter("count > 1").limit(1).count()
    id_, content = free_name(docs, "parley_id"), free_name(docs, "parley_content")
    rows = docs.withColumns({id_: F.coalesce("doc_id", F.lit(NO_ID)), content: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = kept.select(F.col("doc_id").alias(id_), F.col("content").alias(content))
    rows = rows.join(kept, [id_, content], "left_semi")
    if repeats:
        rows = rows.dropDuplicates([id_, content])
    return rows.select(*docs.columns)
