"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too, in its own text or another.  All
strings are judged on the input.  Texts are whole UTF-8 bytes; strings never cross texts.

1. Every string start has one anchor: the leftmost place of the smallest 16-byte hash in its string at which ``CORE``
   bytes fit.  Equal strings have equal anchors, so strings need comparing only under one anchor.  Starts with one
   anchor place form a context, the bytes from the first start to the end of the last string.
2. Equal contexts of one batch settle one another at once; the others, and one of each settled kind, are shuffled by
   anchor.  Anchors that stand once are done.  Equal contexts settle one another: all their
   strings repeat.  Of anchors with different contexts, one context of each kind goes on, with its multiplicity.
3. Those contexts are dealt into shards, and every shard's transform is built from its own bytes, over symbols of
   ``SYMBOL`` bytes.  The shard transforms are merged without sorting suffixes again: an interleave vector, first shard
   after shard, is refined pass by pass by the symbols before each suffix, and nothing else orders across shards.  After
   p passes suffixes stand in order of their first p * SYMBOL bytes, and the pass that first parts two neighbours bounds
   their common prefix.  Neighbours unparted after LENGTH / SYMBOL passes share LENGTH bytes: the repeated intervals.
4. Repeated starts become byte spans per text, which are cut out.

An anchor with more than ``MOST_CONTEXTS`` different contexts doesn't fit one merge; its strings are instead counted by
128-bit digest with partial aggregation, which finds the same starts for any number of contexts.

Null texts are empty; texts under LENGTH bytes keep everything; rows that repeat whole are copies of one another;
a null doc_id is an id like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, bounded_batches, materialize, mix64, utf8

LENGTH = 200
#: Bytes of an anchor, and of a symbol of the transforms.
CORE, SYMBOL = 64, 8
MOST_CONTEXTS = 4000
#: Context bytes merged at once (so few that symbols have 16-bit numbers; an anchor with more takes more), and shards they
#: are dealt into.
MERGE_BYTES, SHARDS = 56 << 10, 4
NO_ID = -(1 << 63)

# ------------------------------------------------------------------ contexts

_PIECE = 1 << 16  # windows handled together; place numbers take 17 bits of a key
_LOW = np.uint64((1 << 17) - 1)


def anchor_places(raw: np.ndarray, length: int = LENGTH, core: int = CORE) -> np.ndarray:
    """For each string start of one stretch of bytes, the place of its anchor."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    w, out = length - core + 1, np.empty(n, np.int64)
    for a in range(0, n, _PIECE):
        m = min(_PIECE, n - a)
        part = np.concatenate([raw[a : a + m + length - 1], np.zeros(8, np.uint8)])
        k = m + w - 1
        x = np.ndarray((k,), "<u8", part.data, strides=(1,)).copy()
        y = np.ndarray((k,), "<u8", part.data, 8, strides=(1,)).copy()
        with np.errstate(over="ignore"):
            x *= np.uint64(0x9E3779B97F4A7C15)
            x += y
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(33)
            x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x &= ~_LOW
        x |= np.arange(k, dtype=np.uint64)
        # Sliding minimum: suffix minima of a block with prefix minima of the next.
        rows = -(-(k + w) // w)
        full = np.full(rows * w, ~np.uint64(0))
        full[:k] = x
        full = full.reshape(rows, w)
        ahead = np.minimum.accumulate(full, axis=1).ravel()
        behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        out[a : a + m] = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & _LOW).astype(np.int64) + a
    return out


def contexts(data: bytes, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor digest, context digest, first start, starts) of each context of one text."""
    place = anchor_places(raw)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    ends = np.concatenate([lo[1:], [len(place)]])
    digest = xxhash.xxh3_64_intdigest
    anchor = np.fromiter((digest(data[p : p + CORE]) for p in place[lo].tolist()), np.uint64, len(lo))
    whole = np.fromiter((digest(data[a : b + LENGTH - 1]) for a, b in zip(lo.tolist(), ends.tolist(), strict=True)), np.uint64, len(lo))
    # The place of the anchor within the context is part of its digest.
    with np.errstate(over="ignore"):
        whole += (place[lo] - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return anchor.view(np.int64), whole.view(np.int64), lo, ends - lo


OCCURRENCES = "anchor bigint, context bigint, doc bigint, mark bigint, lo int, n int, mult int"
_NAMES = ["anchor", "context", "doc", "mark", "lo", "n", "mult"]
_KINDS = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)


def settle_in_batch(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Equal contexts of one batch settle one another before anything is shuffled.

    Their rows go on with mult 0 and an anchor that only spreads them; one row, of mult 2, stands for them all.  So a
    group of copies sends its anchor a row a batch, whatever its size.
    """
    anchor, context = cols[0], cols[1]
    order = np.lexsort((context, anchor))
    new = np.concatenate(([True], (anchor[order[1:]] != anchor[order[:-1]]) | (context[order[1:]] != context[order[:-1]])))
    first = np.flatnonzero(new)
    many = np.diff(np.concatenate([first, [len(order)]])) > 1
    group = np.cumsum(new) - 1
    settled, stands = order[many[group]], order[first[many]]
    mult = np.ones(len(anchor), np.int32)
    mult[settled] = 0
    spread = anchor.copy()
    spread[settled] ^= mix64(cols[2][settled].view(np.uint64) ^ cols[4][settled].astype(np.uint64)).view(np.int64)
    out = [spread, context, *cols[2:], mult]
    return [np.concatenate([c, r]) for c, r in zip(out, [*(c[stands] for c in cols), np.full(len(stands), 2, np.int32)], strict=True)]


def find_contexts(batches):
    """(doc, mark, text) -> OCCURRENCES."""
    for b in batches:
        raw, at, _ = utf8(b.column("text"))
        data = raw.tobytes()
        docs, marks = b.column("doc").to_numpy(zero_copy_only=False), b.column("mark").to_numpy(zero_copy_only=False)
        found = [[] for _ in _NAMES[:-1]]
        for i in np.flatnonzero(np.diff(at) >= LENGTH):
            a, c, lo, n = contexts(data[at[i] : at[i + 1]], raw[at[i] : at[i + 1]])
            for col, x in zip(found, (a, c, np.full(len(a), docs[i]), np.full(len(a), marks[i]), lo, n), strict=True):
                col.append(x)
        if found[0]:
            cols = settle_in_batch([np.concatenate(x).astype(k) for x, k in zip(found, _KINDS, strict=False)])
            yield pa.record_batch([pa.array(c) for c in cols], _NAMES)


class Classifier:
    """Reads occurrences sorted by (anchor, context); holds two of them at most between batches.

    Rows of mult 0 are settled already; a row of mult 2 stands for such rows.  Gives rows (anchor, doc, mark, lo, n, mult):
    mult 0 for strings that an equal context has settled, else a context that must be compared with the others of its
    anchor, standing once (1) or more often (2).
    """

    def __init__(self):
        self.held = None

    def take(self, cols: dict[str, np.ndarray], final: bool = False):
        done = cols["mult"] == 0
        before = {k: cols[k][done] for k in ("anchor", "doc", "mark", "lo", "n", "mult")}
        got = self.compare({k: v[~done] for k, v in cols.items()}, final)
        return before if got is None else {k: np.concatenate([before[k], got[k]]) for k in before}

    def compare(self, cols: dict[str, np.ndarray], final: bool):
        n = len(cols["anchor"])
        cols = cols | {"count": cols["mult"].astype(np.int64), "settled": cols["mult"] == 2, "sent": np.zeros(n, bool)}
        if self.held is not None:
            cols = {k: np.concatenate([self.held[k], v]) for k, v in cols.items()}
            self.held = None
        n = len(cols["anchor"])
        if not n:
            return None
        new_anchor = np.concatenate(([True], cols["anchor"][1:] != cols["anchor"][:-1]))
        new = new_anchor | np.concatenate(([True], cols["context"][1:] != cols["context"][:-1]))
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        count = np.add.reduceat(cols["count"], first)
        group = np.cumsum(new_anchor)[first] - 1
        many = np.bincount(group)[group] >= 2
        settled = ~cols["settled"] & (count[run] >= 2)
        whole = np.ones(len(first), bool)
        whole[-1] = final  # the last run may go on in the next batch
        send = first[many & whole & ~cols["sent"][first]]
        if not final:
            keep = [first[-1]]
            if many[-1]:
                keep.insert(0, first[-2])
            self.held = {k: v[keep].copy() for k, v in cols.items()}
            self.held["count"][-1] = min(count[-1], 2)
            self.held["settled"][:] |= count[run[keep]] >= 2
            if many[-1]:
                self.held["sent"][0] = True
        rows = np.concatenate([np.flatnonzero(settled), send])
        mult = np.concatenate([np.zeros(int(settled.sum()), np.int64), np.minimum(count[run[send]], 2)])
        return {k: cols[k][rows] for k in ("anchor", "doc", "mark", "lo", "n")} | {"mult": mult.astype(np.int32)}


CLASSIFIED = "anchor bigint, doc bigint, mark bigint, lo int, n int, mult int"


def classify(batches):
    state, names = Classifier(), ["anchor", "doc", "mark", "lo", "n", "mult"]
    for b in batches:
        got = state.take({k: b.column(k).to_numpy(zero_copy_only=False) for k in _NAMES})
        if got and len(got["anchor"]):
            yield pa.record_batch([pa.array(got[k]) for k in names], names)
    empty = {k: np.zeros(0, t) for k, t in zip(_NAMES, _KINDS, strict=True)}
    got = state.take(empty, final=True)
    if got and len(got["anchor"]):
        yield pa.record_batch([pa.array(got[k]) for k in names], names)


# ------------------------------------------------------------------ transforms


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable counting order of non-negative integers, 16 bits at a time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    rest = keys >> 16
    while rest.any():
        order = order[np.argsort((rest[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        rest = rest >> 16
    return order


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], ranked[1:] != ranked[:-1])))
    return out


def words_at(raw: np.ndarray, size: int = SYMBOL) -> np.ndarray:
    """The symbols: for every place, the ``size`` = 8 bytes from it as a number in byte order (zeros after the end)."""
    padded = np.concatenate([raw, np.zeros(size, np.uint8)])
    return np.ndarray((len(raw),), ">u8", padded.data, strides=(1,)).astype(np.uint64)


class Transform:
    """A shard's transform, of its own bytes alone: its suffixes (by place) in order of their first LENGTH bytes, and the
    symbol before each.

    ``before`` counts only where ``has_before``: a suffix within the first SYMBOL places of the shard has no symbol before
    it.  ``tails`` are the symbols of the last SYMBOL places, whose following suffix is empty.
    """

    def __init__(self, raw: np.ndarray, start: int, end: int, size: int = SYMBOL):
        own = words_at(raw[start:end])
        rank, known = dense(own), size
        while known < LENGTH:  # prefix doubling within the shard
            step = min(known, LENGTH - known)
            later = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(own)), np.int64)])[: len(own)]
            rank, known = dense(rank * (len(own) + 1) + later), known + step
        order = stable_order(rank)
        self.place = order + start
        self.has_before = order >= size
        self.before = own[order - size]
        self.row = np.empty(len(own), np.int32)  # where each suffix stands
        self.row[order] = np.arange(len(own), dtype=np.int32)
        self.back = self.row[order - size]  # where the suffix that starts one symbol earlier stands
        self.tail_rows, self.tails = self.row[max(0, len(own) - size) :], own[max(0, len(own) - size) :]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def number_symbols(shards: list[Transform]) -> None:
    """Replaces the shards' symbols by their ranks in one alphabet, which is merged from the shards' sorted alphabets."""
    alphabet = distinct(np.concatenate([distinct(np.concatenate([t.before, t.tails])) for t in shards]))
    for t in shards:
        t.before, t.tails = (np.searchsorted(alphabet, x).astype(np.int32) for x in (t.before, t.tails))
        t.before[~t.has_before] = -1


def merge(shards: list[Transform], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave: the merged rows, as numbers of the shards' rows one shard after another; block: rows with one number
    share ``passes`` symbols).

    Every pass walks the interleave, takes each row's preceding symbol, and deals the rows that those lead back to
    stably by symbol; the rows that precede nothing but the end of their shard come first.  Rows of one shard never
    change their order.
    """
    number_symbols(shards)
    base = np.concatenate(([0], np.cumsum([len(t.place) for t in shards]))).astype(np.int32)
    before = np.concatenate([t.before for t in shards])
    back = np.concatenate([t.back + b for t, b in zip(shards, base, strict=False)])
    tails = np.concatenate([t.tails for t in shards])
    tail_rows = np.concatenate([t.tail_rows + b for t, b in zip(shards, base, strict=False)])
    interleave = np.arange(len(before), dtype=np.int32)
    block = np.zeros(len(before), np.int32)
    for p in range(passes):
        symbol = before[interleave]
        at = np.flatnonzero(symbol >= 0)
        symbol = np.concatenate([tails, symbol[at]])
        # The empty suffix shares no symbol with others, but as many as any before the first pass: none.
        came = np.concatenate([np.full(len(tails), -1 if p else 0, np.int32), block[at]])
        order = stable_order(symbol)
        interleave = np.concatenate([tail_rows, back[interleave[at]]])[order]
        symbol, came = symbol[order], came[order]
        block = np.cumsum(np.concatenate(([False], (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1]))), dtype=np.int32)
    return interleave, block


def repeated_starts(texts: list[bytes], starts: list[int], mult: np.ndarray, n_shards: int = SHARDS) -> list[np.ndarray]:
    """For each context, which of its first ``starts`` strings repeat among all contexts; mult 2 repeats by itself."""
    passes = LENGTH // SYMBOL
    lengths = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    # Contiguous shards of whole contexts.
    cuts = np.unique(np.searchsorted(at, np.linspace(0, at[-1], min(n_shards, len(texts)) + 1)))
    shards = [Transform(raw, at[a], at[b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    interleave, block = merge(shards, passes)
    place = np.concatenate([t.place for t in shards])[interleave]
    weight = np.zeros(len(raw), np.int64)
    for a, n, m in zip(at[:-1], starts, mult.tolist(), strict=True):
        weight[a : a + n] = m
    repeated = np.zeros(len(raw), bool)
    repeated[place] = np.bincount(block, weight[place])[block] >= 2
    return [np.flatnonzero(repeated[a : a + n]) for a, n in zip(at[:-1], starts, strict=True)]


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive numbers: (first, how many)."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    return starts[cut], np.diff(np.concatenate([cut, [len(starts)]]))


SPANS = "doc bigint, mark bigint, lo int, n int"
CUT = "anchor bigint, doc bigint, mark bigint, lo int, n int, mult int, bytes binary"


def merge_contexts(batches):
    """CUT rows sorted by anchor -> SPANS of the repeated starts of contexts that stand once."""
    names = ["doc", "mark", "lo", "n"]
    held: list[pa.RecordBatch] = []
    held_bytes = 0

    def settle(t: pa.Table):
        texts = t.column("bytes").to_pylist()
        doc, mark, lo, n, mult = (t.column(c).to_numpy() for c in ("doc", "mark", "lo", "n", "mult"))
        out = [[], [], [], []]
        for i, starts in enumerate(repeated_starts(texts, n.tolist(), mult)):
            if mult[i] == 1 and len(starts):
                first, many = spans(starts)
                for col, x in zip(out, (np.full(len(first), doc[i]), np.full(len(first), mark[i]), first + lo[i], many), strict=True):
                    col.append(x)
        if out[0]:
            kinds = (np.int64, np.int64, np.int32, np.int32)
            yield pa.record_batch([pa.array(np.concatenate(x).astype(k)) for x, k in zip(out, kinds, strict=True)], names)

    for b in batches:
        while b.num_rows:
            # Rows of anchors that are complete are merged as soon as enough bytes wait.
            sizes = np.diff(utf8(b.column("bytes"))[1])
            anchor = b.column("anchor").to_numpy(zero_copy_only=False)
            last = held[-1].column("anchor")[-1].as_py() if held else None
            over = np.flatnonzero(held_bytes + np.cumsum(sizes) > MERGE_BYTES)
            starts = np.flatnonzero(np.concatenate(([anchor[0] != last], anchor[1:] != anchor[:-1])))
            cut = starts[starts >= over[0]] if len(over) else starts[:0]
            cut = cut[(cut > 0) | bool(held)][:1]
            if len(cut):
                head = b.slice(0, int(cut[0]))
                yield from settle(pa.Table.from_batches([*held, *([head] if head.num_rows else [])]))
                held, held_bytes, b = [], 0, b.slice(int(cut[0]))
            else:
                held.append(b)
                held_bytes += int(sizes.sum())
                break
    if held:
        yield from settle(pa.Table.from_batches(held))


def cut_contexts(batches):
    """(doc, mark, text, wanted: list of (anchor, lo, n, mult)) -> CUT."""
    names = [c.split(" ")[0] for c in CUT.split(", ")]
    for b in batches:
        for doc, mark, text, wanted in zip(b.column("doc").to_pylist(), b.column("mark").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("wanted").to_pylist(), strict=True):
            for k in range(0, len(wanted), 8192):
                w = wanted[k : k + 8192]
                cols = [[x["anchor"] for x in w], [doc] * len(w), [mark] * len(w), [x["lo"] for x in w], [x["n"] for x in w], [x["mult"] for x in w]]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array([text[x["lo"] : x["lo"] + x["n"] + LENGTH - 1] for x in w], pa.binary())], names)


STRINGS = "digest binary, doc bigint, mark bigint, lo int, n int, mult int"


def string_digests(batches):
    """CUT rows -> one row for each string, with its digest: for anchors with too many contexts for one merge."""
    names = ["digest", "doc", "mark", "lo", "n", "mult"]
    for b in batches:
        for r in b.to_pylist():
            data = r["bytes"]
            d = [xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in range(r["n"])]
            k = len(d)
            cols = [pa.array(d, pa.binary()), pa.array([r["doc"]] * k, pa.int64()), pa.array([r["mark"]] * k, pa.int64()), pa.array(np.arange(r["lo"], r["lo"] + k, dtype=np.int32)), pa.array(np.ones(k, np.int32)), pa.array([r["mult"]] * k, pa.int32())]
            yield pa.record_batch(cols, names)


# ------------------------------------------------------------------ operator


def repeated_spans(rows: DataFrame) -> DataFrame:
    """rows(doc, mark, text) -> SPANS: the starts of all strings that stand twice or more.

    Contexts are cut in the query that removes them, whatever their anchors hold: it shuffles the texts once, by document,
    and every join of it reads that exchange.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    found = rows.mapInArrow(find_contexts, OCCURRENCES)
    found = found.repartition(parts, "anchor").sortWithinPartitions("anchor", "context")
    found = materialize(found.mapInArrow(classify, CLASSIFIED), "repeats")
    settled = found.filter("mult = 0").select("doc", "mark", "lo", "n")
    compare = found.filter("mult > 0")
    large = materialize(compare.groupBy("anchor").count().filter(F.col("count") > MOST_CONTEXTS).select("anchor"), "large-anchors")

    def cut(part: DataFrame) -> DataFrame:
        wanted = part.groupBy("doc", "mark").agg(F.collect_set(F.struct("anchor", "lo", "n", "mult")).alias("wanted"))
        return rows.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "wanted").mapInArrow(cut_contexts, CUT)

    merged = cut(compare.join(large, "anchor", "left_anti")).repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(merge_contexts, SPANS)
    each = cut(compare.join(large, "anchor", "left_semi")).mapInArrow(string_digests, STRINGS)
    twice = each.groupBy("digest").agg(F.sum("mult").alias("k")).filter("k >= 2").select("digest")
    counted = each.filter("mult = 1").join(twice, "digest", "left_semi").select("doc", "mark", "lo", "n")
    return settled.unionByName(merged).unionByName(counted)


def kept_parts(n: int, found: list[dict] | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(kept, removed) byte slices of a text of n bytes."""
    if not found:
        return ([(0, n)] if n else []), []
    step = np.zeros(n + 1, np.int32)
    lo = np.array([x["lo"] for x in found], np.int64)
    end = lo + np.array([x["n"] for x in found], np.int64) + LENGTH - 1
    np.add.at(step, lo, 1)
    np.add.at(step, end, -1)
    gone = np.concatenate(([False], np.cumsum(step[:-1]) > 0, [False]))
    edge = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
    removed = list(zip(edge[::2], edge[1::2], strict=True))
    kept, at = [], 0
    for a, b in removed:
        kept.append((at, a))
        at = b
    kept.append((at, n))
    return [(a, b) for a, b in kept if a < b], removed


@arrow_function("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")
def remove_spans(text: pa.Array, found: pa.Array) -> pa.Array:
    """What is left of each text; cuts may fall inside a character, so it is binary."""
    out = []
    for t, f in zip(text.cast(pa.binary()).to_pylist(), found.to_pylist(), strict=True):
        t = t or b""
        kept, removed = kept_parts(len(t), f)
        out.append((len(t), sum(b - a for a, b in removed), len(removed), b"".join(t[a:b] for a, b in kept)))
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])


def identified(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): equal rows are one text twice, so an id and a 64-bit mark of the text name it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = identified(docs)
    found = repeated_spans(rows).groupBy("doc", "mark").agg(F.collect_set(F.struct("lo", "n")).alias("found"))
    out = rows.join(found, ["doc", "mark"], "left").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), remove_spans("text", "found").alias("r"))
    return out.select("doc_id", "r.*")


def kept_sha256(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with what the removal of repeated 200-byte strings leaves of it."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
