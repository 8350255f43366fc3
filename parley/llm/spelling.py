"""Spelling variants: words that one code point parts, found by a rare-first prefix filter over positional bigrams.

A text's words are its maximal runs of letters, with A-Z lower-cased.  One edit spoils two bigrams of a word at most.  So
if all bigrams are ordered by their frequency over the vocabulary, the rarest first, two near words share one of the three
rarest bigrams of each: the first in that order that the edit spares.  The edit lies on one side of that bigram; on the
other side the words are equal, which limits its position: it stands equally far from the start of both words, or from
the end.  Words are therefore joined on (bigram, side, what lies on that side).  Where that is a few letters only, the
half of the rest that the edit spares is added to the key, for each of the lengths that the pair may have.  Pairs of a
bucket are compared by the parities of their bigrams and then verified letter by letter, so no row is made of a pair that
isn't near.

A word's form is its near word with the most occurrences (of equals the first in code-point order), where that has at
least ``times`` as many; ``root`` follows the forms to the last.  Null and empty texts have no words; a null doc_id is
written as ``null`` where the id is hashed; rows that repeat count each; an empty table gives no words.  Other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded_batches, fixed_multipliers, materialize, mix64, utf8
from parley.llm.simhash import BLOCK, SMALL, Near, in_buckets, large_buckets, small_pairs, whole_buckets

MIN_LENGTH, MIN_COUNT, TIMES = 7, 2, 10
#: Of the bigrams that a word has, so many of the rarest are joined: an edit spoils two.
RAREST = 3
#: An equal side of fewer letters than this is joined together with an equal half of the rest.
SHORT_SIDE = 6
#: One run in so many loses a letter in the contract query.
TYPO_EVERY = 31
#: Different words that a task counts before it sends them on.
HELD_WORDS = 1 << 18
_GRAM_BITS = mix64(np.arange(1 << 16, dtype=np.uint64) * fixed_multipliers(1, 12)[0]) & np.uint64(63)


# ------------------------------------------------------------------ words


def spoil(run: str, doc_id, every: int) -> str:
    """The run without one code point, if the checksum of ``<doc_id>:<run>`` says so."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[: (at := h % len(run))] + run[at + 1 :]


def count_words(min_length: int, every: int):
    """(doc_id, text) -> (word, n), partial counts.  ``every`` 0 leaves the runs as they are."""
    run = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")  # shorter runs give no word

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def flow(batches):
        held: Counter = Counter()
        for batch in batches:
            raw, at, _ = utf8(batch.column("text"))
            data = raw.tobytes().lower()  # A-Z only
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = Counter(run.findall(data[at[i] : at[i + 1]].decode()))
                if not every:
                    held.update(own)
                    continue
                for x, n in own.items():
                    x = spoil(x, doc_id, every)
                    if len(x) >= min_length:
                        held[x] += n
            if len(held) > HELD_WORDS:
                yield counted(held)
                held = Counter()
        yield counted(held)

    return flow


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = 0) -> DataFrame:
    """docs(doc_id, text) -> (word, n) of the words that are long and frequent enough."""
    bounded_batches(docs.sparkSession)
    parts = docs.select("doc_id", "text").mapInArrow(count_words(min_length, typo_every), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ------------------------------------------------------------------ bigrams


def letters_of(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words as Latin-1 bytes, one a letter; their letters in a row; where each word starts and the last ends."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    n = np.fromiter(map(len, words), np.int64, len(words))
    return words, np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(n)))


def bigrams_of(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram, its word, its position) of all words in a row."""
    n = np.diff(at)
    word = np.repeat(np.arange(len(n)), np.maximum(n - 1, 0))
    place = np.arange(len(word)) - np.repeat(np.cumsum(np.maximum(n - 1, 0)) - np.maximum(n - 1, 0), np.maximum(n - 1, 0))
    first = at[word] + place
    return (letters[first].astype(np.int64) << 8) | letters[first + 1], word, place


def count_bigrams(batches):
    """(word) -> (gram, n): one table a task, of 65,536 entries at most."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        _, letters, at = letters_of(batch.column("word"))
        total += np.bincount(bigrams_of(letters, at)[0], minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])


def bigram_order(words: DataFrame) -> np.ndarray:
    """The rank of each bigram, the rarest first; bigrams of 90 letters, so 8,100 rows reach the driver at most."""
    counts = words.select("word").mapInArrow(count_bigrams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(1 << 16, np.int64)
    n[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    rank = np.empty(1 << 16, np.int32)
    rank[np.lexsort((np.arange(1 << 16), n))] = np.arange(1 << 16)
    return rank


def rarest(rank: np.ndarray, letters: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Positions of each word's RAREST first bigrams in the order of (rank, position)."""
    gram, word, place = bigrams_of(letters, at)
    order = np.lexsort((place, rank[gram], word))
    starts = np.searchsorted(word, np.arange(len(at)))
    nth = np.arange(len(order)) - starts[word]  # order keeps words together, so word[order] is word
    take = nth < RAREST
    return [x.tolist() for x in np.split(place[order][take], np.cumsum(np.minimum(np.diff(starts), RAREST))[:-1])]


def keys_of(w: bytes, p: int) -> list[tuple[int, bytes]]:
    """(kind, key) of a word for its bigram at p: what is equal if the edit lies right of it, and if it lies left."""
    out = []
    for kind, same, rest in ((0, w[: p + 2], w[p + 2 :]), (1, w[p:], w[:p])):
        if len(same) >= SHORT_SIDE:
            out.append((kind, same))
            continue
        # The shorter word of a pair has m letters in its rest; the edit spares the first m // 2 or the others.
        for m in (len(rest), len(rest) - 1):
            if m >= 0:
                half = m // 2
                mark = b"%d|%d|" % (m, len(same)) + same
                out.append((2 + kind, mark + b"<" + rest[:half]))
                out.append((4 + kind, mark + b">" + rest[len(rest) - (m - half) :]))
    return out


def bucket_rows(rank: np.ndarray):
    """(word, n) -> (slot, key, word, n): a row for each bucket of a word."""

    def flow(batches):
        for batch in batches:
            words, letters, at = letters_of(batch.column("word"))
            slot, key, row = [], [], []
            for i, places in enumerate(rarest(rank, letters, at) if words else ()):
                w = words[i]
                for p in places:
                    for kind, part in keys_of(w, p):
                        slot.append(kind)
                        # The bigram is named too: a short side may start or end alike by another of its bigrams.
                        key.append(xxhash.xxh3_64_intdigest(w[p : p + 2] + part, kind))
                        row.append(i)
            rows = pa.array(row, pa.int64())
            keys = pa.array(np.array(key, np.uint64).view(np.int64))
            yield pa.record_batch([pa.array(slot, pa.int32()), keys, batch.column("word").take(rows), batch.column("n").take(rows)], ["slot", "key", "word", "n"])

    return flow


# ------------------------------------------------------------------ pairs


def parities(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits a word: the parity of its bigrams of each class.  One edit turns four of them at most."""
    gram, word, _ = bigrams_of(letters, at)
    out = np.zeros(len(at) - 1, np.uint64)
    starts = np.searchsorted(word, np.arange(len(at)))
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.bitwise_xor.reduceat(np.uint64(1) << _GRAM_BITS[gram], starts[some])
    return out


def one_edit(a: bytes, b: bytes) -> bool:
    """They differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_pairs(batches):
    """Rows sorted by (slot, key) -> (word, near, near_n), both ways; a pair may come from more than one bucket."""
    for rows, cut in whole_buckets(batches):
        words, letters, at = letters_of(rows.column("word"))
        n, size = rows.column("n").to_numpy(), np.diff(at)
        near = Near([parities(letters, at)], 4)
        found = [np.zeros((0, 2), np.int64)]
        for own in large_buckets(cut):
            own = own[np.argsort(size[own], kind="stable")]
            step = max(1, BLOCK // len(own))
            for k in range(0, len(own), step):
                # Words of lengths that fit stand together; earlier ones have met these already.
                take = own[k : k + step]
                rest = own[k : np.searchsorted(size[own], size[take[-1]] + 1, side="right")]
                r, c = near.grid(take, rest)
                found.append(np.stack([take[r[c > r]], rest[c[c > r]]], axis=1))
        for x, y in small_pairs(cut, np.zeros(len(words), np.int32), near):
            found.append(np.stack([x, y], axis=1))
        pairs = np.concatenate(found)
        pairs = pairs[np.abs(size[pairs[:, 0]] - size[pairs[:, 1]]) <= 1]
        pairs = pairs[[one_edit(words[x], words[y]) for x, y in pairs.tolist()]] if len(pairs) else pairs
        for k in range(0, len(pairs), 1 << 15):
            x, y = pairs[k : k + (1 << 15)].T
            a, b = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
            yield pa.record_batch([rows.column("word").take(a), rows.column("word").take(b), pa.array(n[b.to_numpy()])], ["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n), one row a word of four letters or more -> (word, near, near_n): each ordered pair of near words once."""
    rank = bigram_order(words)
    rows = words.select("word", "n").mapInArrow(bucket_rows(rank), "slot int, key bigint, word string, n bigint")
    pairs = in_buckets(rows).mapInArrow(near_pairs, "word string, near string, near_n bigint")
    # One shuffle by word serves this and the grouping by word after it; a word of L letters has 90 (2 L + 1) near ones at most.
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def roots_of(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): every round follows twice as many forms; counts grow tenfold by each, so chains are short."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words(word, n) -> (word, form, root, n, n_near, form_n); every word is kept."""
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    much = F.col("form_n") >= times * F.col("n")
    found = materialize(found.withColumns({"form": F.when(much, F.col("form")), "form_n": F.when(much, F.col("form_n"))}), "forms")
    roots = roots_of(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words counted, its form and its root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_forms(materialize(vocabulary(docs, typo_every=TYPO_EVERY), "words"))
