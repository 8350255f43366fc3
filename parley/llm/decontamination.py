"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size.  MinHash estimates resemblance, which sinks where a short item sits in a long document, so
each size class compares its items with windows of the documents that fit it: blocks of half the class's upper bound,
three in a row, starting at every block.  A passage of up to that bound lies in one window whole.  From the bound and the
window follows the least resemblance of a pair at the wanted containment, and from that the bands and rows that miss
such a pair with a probability of ``MISS`` at most; one row a band needs the fewest hashes, and its false candidates only
cost a count.  A band that an item and a window share names a candidate, which is verified by counting the item's
distinct shingles in the whole document.

What a window doesn't hold together, the search can't see: an item whose shingles are scattered over a long document.

Words are runs of letters, digits and underscores of the lower-cased text; shingles have five words, and an item of
fewer words is one shingle of its length.  Windows leave out shingles with a word that no item has, which only raises the
resemblance.  Items without a word match nothing, null texts are empty, repeated rows are judged each for themselves,
and items with a null id like any other.  Items go to the executors in blocks of bounded size, one scan of the documents
each, and the driver holds one block at a time.  Columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, bounded_batches, fixed_multipliers, materialize

WORDS = re.compile(r"\w+")
SHINGLE = 5
CONTAINMENT = 0.8
#: Items sent to the executors at once; more go in further blocks.
BLOCK_ITEMS = 20_000
#: The most probable loss of a pair at the wanted containment, and words that are searched together.
MISS, GROUP_WORDS = 1e-6, 1 << 18
_KEYS = fixed_multipliers(SHINGLE, 29)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def shingles_of(words: list[str]) -> set[tuple[str, ...]]:
    if not words:
        return set()
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def size_class(n: int) -> int:
    """The upper bound of the partition that n shingles fall in: 1, 2, 3, 4, 6, 8, 12, 16, 24, ..."""
    u = 1 << (n - 1).bit_length()
    return 3 * u // 4 if n <= 3 * u // 4 and u > 2 else u


def bands_for(resemblance: float) -> int:
    """Bands of one row that miss a pair of this resemblance with a probability of MISS at most."""
    return 1 if resemblance >= 1 else math.ceil(math.log(MISS) / math.log1p(-resemblance))


def multipliers(n: int) -> np.ndarray:
    return fixed_multipliers(max(n, 1), 31)


def hashed(keys: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys ^ (keys >> np.uint64(29))) * multiplier) >> np.uint64(32)


class SizeClass:
    """The signatures of the items of one size and shingle width, for windows of three blocks."""

    def __init__(self, upper: int, items: list[tuple[int, np.ndarray]], containment: float):
        self.block = -(-upper // 2)
        least = min(len(keys) for _, keys in items)
        self.bands = bands_for(containment * least / (3 * self.block + (1 - containment) * least))
        at = np.concatenate(([0], np.cumsum([len(keys) for _, keys in items])))
        flat, rows = np.concatenate([keys for _, keys in items]), np.array([row for row, _ in items], np.int64)
        self.minima = []  # per band: sorted signature values, their items, and which upper 16 bits occur
        for m in multipliers(self.bands):
            low = np.minimum.reduceat(hashed(flat, m), at[:-1])
            order = np.argsort(low, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[low >> np.uint64(16)] = True
            self.minima.append((low[order], rows[order], seen))

    def windows(self, doc: np.ndarray, place: np.ndarray):
        """Blocks that have shingles: (first shingle, document) of each, and which of the two next blocks are in its window."""
        number = place // self.block
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]))))
        doc, number = doc[first], number[first]
        reach = [np.flatnonzero((doc[k:] == doc[:-k]) & (number[k:] - number[:-k] <= 2)) for k in (1, 2)]
        return first, doc, reach

    def candidates(self, band: int, hashes: np.ndarray, first: np.ndarray, reach: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that share the band."""
        own = np.minimum.reduceat(hashes, first)
        low = own.copy()
        for k, at in enumerate(reach, 1):
            low[at] = np.minimum(low[at], own[at + k])
        values, rows, seen = self.minima[band]
        some = np.flatnonzero(seen[low >> np.uint64(16)])
        a, b = np.searchsorted(values, low[some], "left"), np.searchsorted(values, low[some], "right")
        n = b - a
        return np.repeat(some, n), rows[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


class ItemIndex:
    """A block of items: exact shingle tables by width, and signatures by size class."""

    def __init__(self, items: list[tuple[int | None, str]], containment: float = CONTAINMENT):
        self.vocabulary: dict[str, int] = {}
        number: dict[tuple[str, ...], int] = {}
        self.item_id, self.size, member = [], [], []
        classes: dict[tuple[int, int], list[tuple[int, list[int]]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if s := shingles_of(words):
                row, k = len(self.item_id), min(SHINGLE, len(words))
                self.item_id.append(item_id)
                self.size.append(len(s))
                own = [number.setdefault(x, len(number)) for x in sorted(s)]
                member += [(at, row) for at in own]
                # A text that repeats itself is longer than its shingles are many; twice their number is enough of it.
                classes[k, size_class(min(len(words) - k + 1, 2 * len(s)))].append((row, own))
        self.size = np.array(self.size, np.int64)
        self.containment = containment
        # Shingles by width: sorted 64-bit keys of word numbers, with the words for an exact comparison.
        self.tables = {}
        width, key_of = defaultdict(list), np.zeros(len(number), np.uint64)
        for x, at in number.items():
            width[len(x)].append(([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in x], at))
        for k, rows in width.items():
            codes, at = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            key = self.key(codes)
            key_of[at] = key
            order = np.argsort(key, kind="stable")
            self.tables[k] = key[order], codes[order], at[order]
        self.members = self.lists(member, len(number))
        self.classes = defaultdict(list)
        for (k, upper), own in sorted(classes.items()):
            self.classes[k].append(SizeClass(upper, [(row, key_of[at]) for row, at in own], containment))

    @staticmethod
    def key(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes.astype(np.uint64) * _KEYS[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)

    @staticmethod
    def lists(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return np.concatenate(([0], np.cumsum(np.bincount(pairs[:, 0], minlength=n)))), pairs[:, 1]

    @staticmethod
    def of(lists: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        starts, values = lists
        return np.concatenate([values[starts[i] : starts[i + 1]] for i in at]) if len(at) else np.zeros(0, np.int64)

    def candidates(self, k: int, keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs that share a band, of shingles of k words in order of document and place."""
        found = [np.zeros((0, 2), np.int64)]
        shapes = [(c, *c.windows(doc, place)) for c in self.classes[k]]
        for band, m in enumerate(multipliers(max(c.bands for c in self.classes[k]))):
            hashes = hashed(keys, m)
            for c, first, of_doc, reach in shapes:
                if band < c.bands:
                    window, item = c.candidates(band, hashes, first, reach)
                    found.append(np.stack([of_doc[window], item], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int]]]:
        """For each text (item, its shingles, those found) of each item that it contains."""
        out: list[list] = []
        get, codes, held = self.vocabulary.get, [], 0
        for text in texts:
            own = words_of(text)
            codes.append(np.fromiter((get(w, 0) for w in own), np.int64, len(own)))
            held += len(own)
            if held > GROUP_WORDS:
                out += self.search_codes(codes)
                codes, held = [], 0
        return out + self.search_codes(codes)

    def search_codes(self, codes: list[np.ndarray]) -> list[list[tuple[int | None, int, int]]]:
        out: list[list] = [[] for _ in codes]
        lengths = np.array([len(c) for c in codes], np.int64)
        start = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.concatenate([*codes, np.zeros(0, np.int64)])
        run = np.concatenate(([0], np.cumsum(flat == 0)))
        for k, (table, exact, numbers) in self.tables.items():
            if len(flat) < k:
                continue
            at = np.flatnonzero(run[k:] == run[:-k])
            doc = np.searchsorted(start, at, "right") - 1
            whole = at + k <= start[doc + 1]
            at, doc = at[whole], doc[whole]
            if not len(at):
                continue
            grams = flat[at[:, None] + np.arange(k)]
            keys = self.key(grams)
            docs, items = self.candidates(k, keys, doc, at - start[doc])
            for d in np.unique(docs):
                a, b = np.searchsorted(doc, (d, d + 1))
                spot = np.minimum(np.searchsorted(table, keys[a:b]), len(table) - 1)
                hit = (table[spot] == keys[a:b]) & (exact[spot] == grams[a:b]).all(axis=1)
                count = np.bincount(self.of(self.members, np.unique(numbers[spot[hit]])), minlength=len(self.item_id))
                for i in items[docs == d]:
                    if count[i] >= self.containment * self.size[i] - 1e-9:
                        out[d].append((self.item_id[i], int(self.size[i]), int(count[i])))
        return out


HITS = "array<struct<item_id:bigint,n_shingles:bigint,n_found:bigint>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64())]))


def searcher(index: ItemIndex):
    @arrow_function(HITS)
    def search(text: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("item_id", "n_shingles", "n_found"), h, strict=True)) for h in own] for own in index.search(text.to_pylist())], _HITS)

    return search


def searchers(docs: DataFrame, items: DataFrame, containment: float, block: int):
    """A search function for each block of items, which maps a text to its hits; one block is in the driver at a time."""
    bounded_batches(docs.sparkSession)
    items = items.select("item_id", "text").filter("text is not null")
    n = max(1, -(-items.count() // block))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield searcher(ItemIndex([(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()], containment)), n


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found) of every document and item it contains."""
    out = None
    for search, n in searchers(docs, items, containment, block):
        hits = docs.select("doc_id", F.explode(search("text")).alias("h")).select("doc_id", "h.*")
        if n > 1:
            hits = materialize(hits, "leaks")
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, block: int = BLOCK_ITEMS) -> DataFrame:
    """The documents that contain no item, with their columns unchanged."""
    for search, n in searchers(docs, items, containment, block):
        docs = docs.filter(F.size(search(F.col("text"))) == 0)
        if n > 1:
            docs = materialize(docs, "clean")
    return docs


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its containment."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))


#: DuckDB SQL for op4_benchmark_decontamination.
OP4_SQL = f"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from documents),
b as (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w from benchmark),
bs as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) as s
  from (select item_id, w, least({SHINGLE}, len(w)) as k from b where len(w) > 0)),
ds as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) as s
  from d, (select distinct k from bs) where len(w) >= k),
n as (select item_id, count(*) as n_shingles from bs group by item_id),
f as (select ds.doc_id, bs.item_id, count(*) as n_found from ds join bs using (k, s) group by all)
select doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) as containment
from f join n using (item_id) where n_found >= {CONTAINMENT} * n_shingles - 1e-9
"""
