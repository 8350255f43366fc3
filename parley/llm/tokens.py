"""Token-ID output: Parquet list columns with chosen encodings, row groups and page indexes.

A dataset holds, in ascending doc_id order over its files: doc_id (delta encoded), n_tokens (delta encoded) and ids, a
list column with dictionary encoding.  Row groups and pages have fixed byte sizes, pages at most ``PAGE_ROWS`` documents, and Spark writes page indexes, so
a reader that wants some documents or only the counts skips the other pages and columns.

White space and the places between letters and other characters always part tokens of this tokenizer, so a text's ids are
the ids of its parts in order; each worker encodes a part once and keeps it in a bounded table.  Null texts are empty: they have the end id alone.
Null doc_ids come first; rows that repeat are written each, and an id that many rows share is split over files.  ``start``
is the place in the files: it is summed over file and row numbers, whatever the ids are.  Other columns of the input are
left out unless ``keep`` names them; a kept column can't have the name of one that is written.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, bounded_batches, free_name, materialize, work_path
from parley.llm.sharding import refuse_clash, totals_before

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 64 << 10, 512
#: Parts that a worker keeps encoded, in each of two generations, and parts that are encoded in one call.
CACHE_PARTS, ENCODE_WORDS = 250_000, 2048


# How word_bpe_49k.json normalises and parts a text.
WORD_NORMALIZERS = ("NFC", "Replace", "Lowercase")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTERS = r" \t\n\r\x0b\x0c", "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Parts of a text between which tokens always part: runs of letters, and runs of other characters than white space.
PARTS = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}{_SPACE}]+")
WORDS = re.compile(rf"[^{_SPACE}]+")
#: Characters that may compose with a neighbour.
ODD = re.compile(rf"[^!-~{_LETTERS}{_SPACE}]")
#: Letter parts that are encoded as one line.
LINE_PARTS = 64


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def is_whole(word: str) -> bool:
    """It has an apostrophe, the start of a special token or an odd character, and so is encoded in one piece."""
    return "'" in word or "<|" in word or ODD.search(word) is not None


def parts_of(text: str) -> list[str]:
    """A text's parts in order; its ids are theirs, one after another."""
    if not is_whole(text):
        return PARTS.findall(text.lower())
    return [x for w in WORDS.findall(text) for x in ([w] if is_whole(w) else PARTS.findall(w.lower()))]


class Generation:
    """Numbered parts and the ids of those that are learned."""

    def __init__(self):
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.spans: tuple[bytes, list[int], list[int]] = b"", [], []

    def close(self) -> Generation:
        """Numbers are only looked up from now on, and ids are cut from bytes."""
        self.number.default_factory = None
        self.spans = self.flat.tobytes(), (4 * self.starts).tolist(), (4 * (self.starts + self.lengths)).tolist()
        self.starts = self.lengths = self.flat = np.zeros(0, np.int64)
        return self


class WordCache:
    """Parts of words to ids by the tokenizers library, in two generations of bounded size.

    What the younger generation asks of the older moves on; the rest of it is forgotten in time.  A tokenizer whose
    tokens depend on white space encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors have their own parallelism
        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        kinds = tuple(n.get("type") for n in (shape.get("normalizer") or {}).get("normalizers", ()))
        first = ((shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        end = shape["model"].get("end_of_word_suffix")
        self.by_word = kinds == WORD_NORMALIZERS and first.get("pattern", {}).get("Regex") == WORD_PATTERN and bool(end)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_word:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(end)]] = True
        self.now, self.older = Generation(), Generation()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for a in range(0, len(texts), ENCODE_WORDS) for e in self.tokenizer.encode_batch_fast(texts[a : a + ENCODE_WORDS], add_special_tokens=False)]

    def encode_parts(self, new: list[str]) -> dict[str, bytes]:
        """Letter parts go as lines, whose ids are cut after every word end; each of them is one word."""
        letters = [x for x in new if x.isalpha()]
        others = [x for x in new if not x.isalpha()]
        out = dict(zip(others, map(packed, self.ids(others)), strict=True))
        lines = [letters[a : a + LINE_PARTS] for a in range(0, len(letters), LINE_PARTS)]
        for own, ids in zip(lines, self.ids([" ".join(x) for x in lines]), strict=True):
            ids = np.array(ids, "<i4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(own) or cut[-1] != len(ids):  # not as expected: one by one
                out.update(zip(own, map(packed, self.ids(own)), strict=True))
                continue
            data, at = ids.tobytes(), 0
            for x, b in zip(own, (4 * cut).tolist(), strict=True):
                out[x] = data[at:b]
                at = b
        return out

    def learn(self) -> None:
        """Finds the ids of the parts that have a number but no ids yet."""
        now, old = self.now, self.older
        waiting = list(islice(now.number, len(now.lengths), None))
        if not waiting:
            return
        at = old.number.get
        known = {x: k for x in waiting if (k := at(x)) is not None}
        new = self.encode_parts([x for x in waiting if x not in known])
        data, starts, ends = old.spans
        got = [new[x] if (k := known.get(x)) is None else data[starts[k] : ends[k]] for x in waiting]
        own = np.fromiter(map(len, got), np.int64, len(got)) // 4
        now.starts = np.concatenate([now.starts, len(now.flat) + np.cumsum(own) - own])
        now.lengths = np.concatenate([now.lengths, own])
        now.flat = np.concatenate([now.flat, np.frombuffer(b"".join(got), "<i4")])

    def encode(self, column: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text, with the end id."""
        texts = column.to_pylist()
        if not self.by_word:
            return pa.array([[*ids, end_id] for ids in self.ids([t or "" for t in texts])], pa.list_(pa.int32()))
        if len(self.now.number) > CACHE_PARTS:
            self.older, self.now = self.now.close(), Generation()
        now, codes, n = self.now, [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = parts_of(text)
                n[i] = len(own)
                codes.append(np.fromiter(map(now.number.__getitem__, own), np.int64, len(own)))
        self.learn()
        codes = np.concatenate(codes)
        lengths = now.lengths[codes]
        part_at = np.concatenate(([0], np.cumsum(n)))
        token_at = np.concatenate(([0], np.cumsum(lengths)))
        ends = token_at[part_at]
        offsets = ends + np.arange(len(ends))
        out = np.full(int(offsets[-1]), end_id, np.int32)
        place = np.ones(len(out), bool)
        place[offsets[1:] - 1] = False
        out[place] = now.flat[np.repeat(now.starts[codes] - token_at[:-1], lengths) + np.arange(int(token_at[-1]))]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


_caches: dict[str, WordCache] = {}


def encoder(path: str, end_id: int):
    @arrow_function("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        if path not in _caches:
            _caches[path] = WordCache(path)
        return _caches[path].encode(text, end_id)

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, keep: tuple[str, ...] = ()) -> None:
    """Writes the dataset; ``keep`` names columns of ``docs`` to write as metadata beside the ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    refuse_clash(docs.select(*keep), ["doc_id", "n_tokens", "ids"])
    rows = docs.select("doc_id", "text", *keep)
    tie = free_name(rows, "parley_tie")
    # The row number parts an id that many rows share; files are in ascending order of doc_id.
    rows = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(max(1, rows.rdd.getNumPartitions()), "doc_id", tie)
    rows = rows.sortWithinPartitions("doc_id", tie)
    encode = encoder(vocabulary or public_tokenizers.path(VOCABULARY), end_id)
    ids = rows.select("doc_id", *keep, encode("text").alias("ids"))
    ids = ids.select("doc_id", *keep, F.size("ids").cast("bigint").alias("n_tokens"), "ids")
    options = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "compression": "zstd",
    }
    ids.write.options(**options).parquet(path)


@arrow_function("bigint")
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of each list as little-endian unsigned 32-bit integers."""
    at = np.asarray(ids.offsets)
    flat = np.asarray(ids.values.fill_null(0)).astype("<u4")
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())


def place() -> tuple[Column, ...]:
    """Where a row stands: the number in its file's name, the name, and its number in the file."""
    name = F.col("_metadata.file_name")
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("int").alias("part_no"), name.alias("file_name"), F.col("_metadata.row_index").alias("row_index")


def placed(rows: DataFrame) -> DataFrame:
    """``start``, from the rows' places in the files; a file's rows meet in one task."""
    return totals_before(rows, ["part_no", "file_name"], ["row_index"], {"start": "n_tokens"}).drop("part_no", "file_name", "row_index")


def read_counts(spark, path: str) -> DataFrame:
    """doc_id, n_tokens and start, the ids of all documents before it; the ids themselves aren't read."""
    return placed(spark.read.parquet(path).select("doc_id", "n_tokens", *place()))


def token_digest(spark, path: str) -> DataFrame:
    """Per document, read back from the files: start, n_tokens and the checksum of the ids."""
    bounded_batches(spark)
    rows = materialize(spark.read.parquet(path).select("doc_id", "n_tokens", ids_crc32("ids").alias("ids_crc32"), *place()), "token-digests")
    return placed(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_ids(spark, sf_dir: str) -> DataFrame:
    """Writes all documents as token ids and returns what the files hold for each."""
    path = work_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digest(spark, path)
