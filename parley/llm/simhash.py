"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has bit j set if more than half of its feature hashes have it.  Two fingerprints link at
``radius`` or fewer differing bits.  The 64 bits are grouped into m partitions, correlated bits together; partition i
gets a threshold t_i >= -1 with sum(t_i + 1) = radius + 1, so a linked pair is within t_i on at least one partition.
Dynamic programming allots the thresholds at the least estimated cost, from bit statistics of a bounded sample (which
changes speed only, never results); m is the cheapest of several.  Fingerprints are indexed by the partition values
within t_i // 2 of theirs and probe those within the rest of t_i, so that values at t_i meet half way; a bucket's pairs
are verified by their full distance.

Equal fingerprints are folded first, so a group of copies is one node whatever its size, and a bucket sends on a
spanning star of its links, never all pairs.  Nothing is capped or sampled away.

Null and wordless texts have fingerprint zero and link like any other.  Null doc_ids never name a component.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, bounded_batches, materialize, utf8
from parley.llm.components import connected_components, star_edges

SEED = 42
BITS = 64
#: Fingerprints from which bit statistics are taken.
PLAN_SAMPLE = 4096
#: Costs of a probe row and of a verified pair, in microseconds.
PROBE_COST, PAIR_COST = 2.0, 0.006


# ------------------------------------------------------------------ fingerprints


def bit_counts(h: np.ndarray, at: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """For each slice of hashes that ``at`` bounds, how many have each bit; in blocks, so memory is bounded."""
    out = np.zeros((len(at) - 1, BITS), dtype=np.int64)
    for a in range(0, len(h), block):
        b = min(len(h), a + block)
        first, last = np.searchsorted(at, a, side="right") - 1, np.searchsorted(at, b, side="left")
        own = np.flatnonzero(at[first + 1 : last + 1] > at[first:last]) + first
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[own] += np.add.reduceat(bits, np.maximum(at[own] - a, 0), axis=0, dtype=np.int64)
    return out


def majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit fingerprints: bit j is set if over half the hashes have it."""
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of k words, joined by spaces; a shorter sequence is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, len(words) - k + 1)


def batch_words(column: pa.Array):
    raw, at, _ = utf8(column)
    data = raw.tobytes().lower()  # A-Z only
    return (data[at[i] : at[i + 1]].split() for i in range(len(at) - 1))


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(h) for h in hashes], np.int64)
    at = np.concatenate(([0], np.cumsum(n)))
    return majority(bit_counts(np.concatenate([*hashes, np.zeros(0, np.uint64)]), at), n)


@arrow_function("bigint")
def shingle_simhash(text: pa.Array) -> pa.Array:
    """64 bits over all 4-word shingles, repeats included."""
    return pa.array(fingerprints([shingle_hashes(w, 4) for w in batch_words(text)]).view(np.int64), pa.int64())


# ------------------------------------------------------------------ plan


class Plan:
    """Partitions (masks) and their thresholds."""

    def __init__(self, groups: list[list[int]], thresholds: list[int], cost: float):
        self.groups, self.thresholds, self.cost = groups, thresholds, cost

    def masks(self) -> list[tuple[int, np.ndarray, list[tuple[int, np.ndarray]]]]:
        """(partition, its mask, [(side, flips)]) of each partition in use: side 0 is indexed, side 1 probes side 0.

        An even threshold needs one side only, whose rows meet each other.
        """
        out = []
        for i, (bits, t) in enumerate(zip(self.groups, self.thresholds, strict=True)):
            if t >= 0:
                near, far = t // 2, t - t // 2
                sides = [(0, flips(bits, 0, near)), (1, flips(bits, near + 1, far))]
                out.append((i, np.uint64(sum(1 << b for b in bits)), sides if far > near else sides[:1]))
        return out


def flips(bits: list[int], least: int, most: int) -> np.ndarray:
    """Masks that flip ``least`` to ``most`` of the bits."""
    return np.array([sum(1 << b for b in c) for k in range(least, most + 1) for c in combinations(bits, k)], np.uint64)


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal size; a group grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).sum(axis=0))
    spread[spread == 0] = 1
    likeness = np.abs(bits.T @ bits) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = len(free) // (m - i)
        rest = sorted(free)
        seed = max(rest, key=lambda b: (likeness[b, rest].sum(), -b))
        own = [seed]
        free.remove(seed)
        while len(own) < size:
            b = max(sorted(free), key=lambda b: likeness[b, own].sum())
            own.append(b)
            free.remove(b)
        groups.append(sorted(own))
    return groups


def allot(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """costs[i][t + 1] for t = -1, 0, ...; the cheapest thresholds with sum(t + 1) = radius + 1."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * (radius + 1)
    for own in costs:
        new: list[tuple[float, list[int]] | None] = [None] * (radius + 2)
        for used, x in enumerate(best):
            for step, c in enumerate(own if x else ()):
                if used + step <= radius + 1 and (new[used + step] is None or x[0] + c < new[used + step][0]):
                    new[used + step] = x[0] + c, [*x[1], step - 1]
        best = new
    return best[-1] if best[-1] else (float("inf"), [])


def rows_each(bits: int, t: int) -> int:
    """Index and probe rows of a fingerprint in a partition of so many bits."""
    return sum(comb(bits, k) for k in range(t - t // 2 + 1))


def make_plan(sample: np.ndarray, n: int, radius: int, most_rows: int = 5000) -> Plan:
    """The cheapest of the partitionings into 2, 3, ... radius + 1 groups for n fingerprints."""
    sample = sample if len(sample) > 1 else np.zeros(2, np.uint64)
    shuffled = np.random.default_rng(1).permutation(sample)
    x = np.bitwise_xor(sample[:, None][:1024], shuffled[None, :1024]).ravel()
    x = x[x != 0] if (x != 0).any() else x
    best = None
    for m in range(1, min(radius + 1, 16) + 1):
        groups = group_bits(sample, m)
        costs = []
        for bits in groups:
            near = np.bincount(np.bitwise_count(x & np.uint64(sum(1 << b for b in bits))), minlength=BITS + 1).cumsum() / len(x)
            own = [0.0]
            for t in range(min(len(bits), radius) + 1):
                rows = rows_each(len(bits), t)
                if rows > most_rows:
                    break
                # A sample can't see shares below its own resolution; then the even spread is the estimate.  A pair
                # within t meets in up to comb(t, t // 2) values.
                share = max(near[t], sum(comb(len(bits), k) for k in range(t + 1)) / 2 ** len(bits))
                own.append(n * (PROBE_COST * rows + PAIR_COST * share * comb(t, t // 2) * n / 2))
            costs.append(own)
        cost, thresholds = allot(costs, radius)
        if best is None or cost < best.cost:
            best = Plan(groups, thresholds, cost)
    return best


# ------------------------------------------------------------------ search


def probe_rows(plan: Plan, fp: str = "fp", carried: tuple[str, ...] = (), first_slot: int = 0):
    """Rows of nodes -> (slot, key, side, node, fp, *carried): a row for each partition value that a node is indexed by or probes."""
    masks = plan.masks()

    def run(batches):
        for batch in batches:
            own = batch.column(fp).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, mask, sides in masks:
                for side, turned in sides:
                    step = max(1, (1 << 16) // len(turned))
                    for a in range(0, len(own), step):
                        keys = (own[a : a + step] & mask)[:, None] ^ turned[None, :]
                        rows = pa.array(np.repeat(np.arange(a, a + len(keys)), len(turned)))
                        cols = [pa.array(np.full(keys.size, first_slot + i, np.int32)), pa.array(keys.ravel().view(np.int64)), pa.array(np.full(keys.size, side, np.int32))]
                        cols += [batch.column(c).take(rows) for c in ("node", fp, *carried)]
                        yield pa.record_batch(cols, ["slot", "key", "side", "node", "fp", *carried])

    return run


PROBE = "slot int, key bigint, side int, node bigint, fp bigint"


def whole_buckets(batches):
    """Rows sorted by (slot, key) -> (rows of whole buckets, the bounds of the buckets).  Only an open bucket is held."""

    def bounded(rows: pa.RecordBatch):
        slot, key = rows.column("slot").to_numpy(), rows.column("key").to_numpy()
        return rows, np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1]), [True])))

    def joined(parts: list) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        slot, key = batch.column("slot").to_numpy(), batch.column("key").to_numpy()
        other = np.flatnonzero((key != key[-1]) | (slot != slot[-1]))
        n = int(other[-1]) + 1 if len(other) else 0
        if n:
            yield bounded(joined([*held, batch.slice(0, n)]))
            held = []
        elif held and (held[-1].column("key")[-1].as_py(), held[-1].column("slot")[-1].as_py()) != (int(key[0]), int(slot[0])):
            yield bounded(joined(held))
            held = []
        held.append(batch.slice(n))
    if held:
        yield bounded(joined(held))


class Links:
    """Verified links, kept as stars once there are many."""

    def __init__(self, most: int = 1 << 20):
        self.a, self.b, self.n, self.most = [], [], 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n > self.most:
                self.stars()

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = star_edges(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.n = [a], [b], len(a)
        self.most = max(self.most, 4 * len(a))
        return a, b


class Near:
    """The test of a pair of rows: every one of their fingerprints is within the radius, and a wide sketch within its own."""

    def __init__(self, prints: list[np.ndarray], radius: int, sketch: np.ndarray | None = None, sketch_radius: int = 0):
        self.prints, self.radius = [p.view(np.uint64) for p in prints], radius
        self.sketch, self.sketch_radius = sketch, sketch_radius  # rows of 64-bit words

    def take(self, rows: np.ndarray) -> Near:
        return Near([p[rows] for p in self.prints], self.radius, None if self.sketch is None else self.sketch[rows], self.sketch_radius)

    def also(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The tests after the first fingerprint's, over pairs."""
        ok = np.ones(len(x), bool)
        for p in self.prints[1:]:
            at = np.flatnonzero(ok)
            ok[at] = np.bitwise_count(p[x[at]] ^ p[y[at]]) <= self.radius
        if self.sketch is not None:
            at = np.flatnonzero(ok)
            for k in range(0, len(at), BLOCK // 8):
                some = at[k : k + BLOCK // 8]
                ok[some] = np.bitwise_count(self.sketch[x[some]] ^ self.sketch[y[some]]).sum(axis=1, dtype=np.int64) <= self.sketch_radius
        return ok

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(self.prints[0][x] ^ self.prints[0][y]) <= self.radius
        at = np.flatnonzero(ok)
        ok[at] = self.also(x[at], y[at])
        return ok

    def grid(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (into x, into y) of the near pairs between two lists."""
        p = self.prints[0]
        r, c = np.nonzero(np.bitwise_count(p[x][:, None] ^ p[y][None, :]) <= self.radius)
        ok = self.also(x[r], y[c])
        return r[ok], c[ok]


#: Rows up to which all buckets of a batch are handled together, and pairs that are tested at once.
SMALL, BLOCK = 64, 1 << 20


def small_pairs(cut: np.ndarray, side: np.ndarray, near: Near):
    """(x, y) of the near pairs in buckets of 2 to SMALL rows, of which one at least is indexed."""
    sizes = np.diff(cut)
    some = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    row_at = np.concatenate([np.arange(cut[k], cut[k + 1]) for k in some]) if len(some) else np.zeros(0, np.int64)
    todo = np.repeat(cut[some + 1], sizes[some]) - row_at - 1
    for a in range(0, len(row_at), BLOCK // SMALL):
        n = todo[a : a + BLOCK // SMALL]
        x = np.repeat(row_at[a : a + BLOCK // SMALL], n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        ok = (side[x] == 0) | (side[y] == 0)
        x, y = x[ok], y[ok]
        ok = near.pairs(x, y)
        yield x[ok], y[ok]


def large_buckets(cut: np.ndarray) -> list[np.ndarray]:
    return [np.arange(cut[k], cut[k + 1]) for k in np.flatnonzero(np.diff(cut) > SMALL)]


def bucket_links(node: np.ndarray, near: Near):
    """Links (a, b) of one large bucket with the components of all.  Dense groups are peeled off whole: what a member
    reaches is not compared again."""
    _, first = np.unique(node, return_index=True)
    node, near = node[first], near.take(first)
    waiting = np.arange(len(node))
    while len(waiting) > SMALL:
        seeds = waiting[np.linspace(0, len(waiting) - 1, 8).astype(int)]
        r, c = near.grid(seeds, waiting)
        best = np.bincount(r, minlength=8)
        if 8 * best.max() < len(waiting):
            break
        # The smallest node of the group starts, so a group has the same hub in all its buckets.
        stack = waiting[[c[r == best.argmax()].min()]]
        waiting = waiting[waiting != stack[0]]
        while len(stack) and len(waiting):
            take = stack[: max(1, BLOCK // len(waiting))]
            stack = stack[len(take) :]
            r, c = near.grid(take, waiting)
            if len(c):
                reached, via = np.unique(c, return_index=True)
                yield node[take[r[via]]], node[waiting[reached]]
                stack = np.concatenate([stack, waiting[reached]])
                waiting = np.delete(waiting, reached)
    step = max(1, BLOCK // max(1, len(waiting)))
    for a in range(0, len(waiting), step):
        take, rest = waiting[a : a + step], waiting[a:]
        r, c = near.grid(take, rest)
        yield node[take[r[c > r]]], node[rest[c[c > r]]]


def verified(radius: int):
    """Reads rows sorted by (slot, key); yields stars of verified links."""

    def run(batches):
        links = Links()
        for rows, cut in whole_buckets(batches):
            side, node, fp = (rows.column(c).to_numpy() for c in ("side", "node", "fp"))
            near = Near([fp], radius)
            for at in large_buckets(cut):
                for a, b in bucket_links(node[at], near.take(at)):
                    links.add(a, b)
            for x, y in small_pairs(cut, side, near):
                links.add(node[x], node[y])
        a, b = links.stars()
        for k in range(0, len(a), 1 << 16):
            yield pa.record_batch([pa.array(a[k : k + (1 << 16)]), pa.array(b[k : k + (1 << 16)])], ["src", "dst"])

    return run


def plan_for(nodes: DataFrame, fp: str, n: int, radius: int) -> Plan:
    """The plan for n nodes, from the bit statistics of a bounded sample."""
    sample = nodes.select(F.col(fp).alias("fp")).orderBy(F.xxhash64("node")).limit(PLAN_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    return make_plan(sample, n, radius)


def in_buckets(rows: DataFrame) -> DataFrame:
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "slot", "key").sortWithinPartitions("slot", "key")


def link_fingerprints(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes(node, fp), one row a node -> links (src, dst) with the same components as all links."""
    if not 0 <= radius < BITS:
        raise ValueError("radius must be 0 to 63")
    plan = plan_for(nodes, "fp", nodes.count(), radius)
    rows = nodes.select("node", "fp").mapInArrow(probe_rows(plan), PROBE)
    return in_buckets(rows).mapInArrow(verified(radius), "src bigint, dst bigint")


def components_of(prints: DataFrame, radius: int) -> DataFrame:
    """prints(doc_id, node, fp) -> (node, component_id): the smallest doc_id that a node reaches."""
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"))
    nodes = materialize(nodes, "nodes")
    roots = connected_components(materialize(link_fingerprints(nodes, radius), "links"), "src", "dst")
    own = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Partial minima first: a component of any size sends one row a partition.
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(smallest, "root").select("node", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint over 4-word shingles and its component at 4 or fewer differing bits.

    One row a row: rows that repeat and equal texts have one fingerprint and so one component.  An empty table gives none.
    """
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = docs.select("doc_id", shingle_simhash("text").alias("fp")).select("doc_id", F.col("fp").alias("node"), "fp")
    prints = materialize(prints, "prints")
    found = prints.join(components_of(prints, 4), "node")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
