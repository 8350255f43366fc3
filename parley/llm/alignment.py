"""Alignment of two tokenizers by a dictionary of token groups.

Both tokenizers cut the same bytes.  Where a token of A and one of B end together a group ends, so a group is a run of A ids
and the run of B ids over the same bytes, written ``a1,a2|b1,b2``.  Every token of one run links with every one of the other.
A corpus has few different groups, and that is what the work is done on:

* Tasks intern the groups of their documents and keep a document as numbers of groups with frequencies, the numbers of a
  chunk of documents beside its part of the dictionary.  They also count in how many documents each pair of ids is linked: a
  group's pairs are looked up once for each document that has it, and a pair counts once however many groups hold it.
* Links are expanded once for each distinct group of the corpus and joined with the counts of their pairs, which gives each
  group the sum of its counts and the number of its best links.
* These come back to the chunks by the group's key, and a document's sums are the values of its groups times frequencies.

White space never ends inside a token unless it starts it, so both tokenizers also part at a single space between two other
characters; a worker encodes what lies between such spaces once and keeps it in a bounded table.

Texts whose joined token bytes differ from space + text of either tokenizer have no tokens, like null and empty ones: zeros
and an empty digest.  Rows that repeat are documents of their own, and so are null ids.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import between, bounded_batches, materialize

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts that a worker keeps, parts encoded as one line, and groups or pairs of ids after which it starts anew.
CACHE_PARTS, LINE_PARTS, MOST_KEPT = 300_000, 128, 1 << 21
#: A chunk of documents ends after so many entries (a document and one of its groups) or documents.
CHUNK_ENTRIES, CHUNK_DOCS = 1 << 20, 1 << 15

#: A single space between two other characters; Python's white space includes that of both tokenizers.
SPLIT, UNEVEN = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s|^\s|\s$|[^\S ]")


def parts_of(text: str) -> list[str]:
    """What lies between single spaces; each part stands for a space and itself."""
    return SPLIT.split(text) if UNEVEN.search(text) else text.split(" ")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """The two tokenizers and the bytes of their entries.  Vocabularies are opened where they are used; None means the installed one."""

    def __init__(self, a: str | None = None, b: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors have their own parallelism
        self.a = Tokenizer.from_file(a or public_tokenizers.path(A_VOCABULARY))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b or public_tokenizers.path(B_VOCABULARY))
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, lines: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """(A ids of space + line, B ids of line, both spell space + line)."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in lines], add_special_tokens=False)]
        b = self.b.encode(lines, num_threads=1)
        out = []
        for line, x, y in zip(lines, a, b, strict=True):
            want = b" " + line.encode()
            out.append((x, y, b"".join(map(self.a_bytes.__getitem__, x)) == want == b"".join(map(self.b_bytes.__getitem__, y))))
        return out


class Dictionary:
    """Parts of texts, the groups they consist of, and the pairs of ids that groups link; all numbered."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.group: dict = {}  # (a, b) of two single ids as one number, else the key
        self.keys: list[str] = []
        self.a_len, self.b_len = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair: dict[int, int] = {}
        self.pair_at, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.forget_parts()

    def forget_parts(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []
        self.starts, self.lengths, self.flat, self.bad = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def intern(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        """Numbers of groups; group g has the A ids a[a_at[g]:a_at[g + 1]] and the B ids alike."""
        na, nb = np.diff(a_at), np.diff(b_at)
        out, new = np.zeros(len(na), np.int32), []
        one = np.flatnonzero((na == 1) & (nb == 1))
        values, back = np.unique((a[a_at[one]].astype(np.int64) << 32) | b[b_at[one]], return_inverse=True)
        codes = np.zeros(len(values), np.int32)
        for i, v in enumerate(values.tolist()):
            if (code := self.group.get(v)) is None:
                code = self.group[v] = len(self.group)
                new.append(([v >> 32], [v & 0xFFFFFFFF]))
            codes[i] = code
        out[one] = codes[back.ravel()]
        xs, ys = a.tolist(), b.tolist()
        for g in np.flatnonzero((na != 1) | (nb != 1)).tolist():
            x, y = xs[a_at[g] : a_at[g + 1]], ys[b_at[g] : b_at[g + 1]]
            key = (*x, -1, *y)
            if (code := self.group.get(key)) is None:
                code = self.group[key] = len(self.group)
                new.append((x, y))
            out[g] = code
        if new:
            self.add(new)
        return out

    def add(self, new: list[tuple[list[int], list[int]]]) -> None:
        pairs, ends, pair = [], [], self.pair
        for x, y in new:
            self.keys.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            own = {(p << 32) | q for p in set(x) for q in set(y)}
            pairs += [pair.setdefault(v, len(pair)) for v in own]
            ends.append(len(pairs))
        self.a_len = np.concatenate([self.a_len, [len(x) for x, _ in new]])
        self.b_len = np.concatenate([self.b_len, [len(y) for _, y in new]])
        self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + np.array(ends)])
        self.pairs = np.concatenate([self.pairs, np.array(pairs, np.int32)])

    def learn(self) -> None:
        """Finds the groups of the parts that have a number but no groups yet."""
        new = list(islice(self.number, len(self.text), None))
        if not new:
            return
        plain, units = [x for x in new if not UNEVEN.search(x) and x], [[x] for x in new if not x or UNEVEN.search(x)]
        units += [plain[k : k + LINE_PARTS] for k in range(0, len(plain), LINE_PARTS)]
        found: dict[str, tuple[np.ndarray, bytes] | None] = {}
        while units:
            again, good = [], []
            for own, (x, y, same) in zip(units, self.tokens.encode([" ".join(u) for u in units]), strict=True):
                if same:
                    good.append((own, x, y))
                elif len(own) > 1:
                    again += [[p] for p in own]
                else:
                    found[own[0]] = None
            units = again + self.cut(good, found)
        at = len(self.flat)
        own = [found[p] or (np.zeros(0, np.int32), b"") for p in new]
        n = np.array([len(g) for g, _ in own], np.int64)
        self.text += [t for _, t in own]
        self.starts, self.lengths = np.concatenate([self.starts, at + np.cumsum(n) - n]), np.concatenate([self.lengths, n])
        self.flat = np.concatenate([self.flat, *(g for g, _ in own)])
        self.bad = np.concatenate([self.bad, np.array([found[p] is None for p in new], bool)])

    def cut(self, good: list, found: dict) -> list[list[str]]:
        """Groups of lines that both tokenizers spell alike; gives back the parts of lines that don't part where tokens end."""
        if not good:
            return []
        a, b = (np.concatenate([np.array(g[k], np.int64) for g in good]) for k in (1, 2))
        a_end, b_end = np.cumsum(self.tokens.a_size[a]), np.cumsum(self.tokens.b_size[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        codes = self.intern(a, np.concatenate(([0], np.searchsorted(a_end, ends) + 1)), b, np.concatenate(([0], np.searchsorted(b_end, ends) + 1)))
        parts = [p for own, _, _ in good for p in own]
        until = np.cumsum([1 + len(p.encode()) for p in parts])
        at = np.searchsorted(ends, until)
        apart = ends[np.minimum(at, len(ends) - 1)] == until
        at = np.concatenate(([0], at + 1))
        again, k, keys = [], 0, self.keys
        for own, _, _ in good:
            if len(own) > 1 and not apart[k : k + len(own)].all():
                again += [[p] for p in own]
            else:
                for i, p in enumerate(own, k):
                    g = codes[at[i] : at[i + 1]]
                    found[p] = g, ";".join(map(keys.__getitem__, g.tolist())).encode()
            k += len(own)
        return again

    def groups_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Group numbers of all texts in a row, their n + 1 bounds, and the digests."""
        if len(self.number) > CACHE_PARTS:
            self.forget_parts()
        number, codes, n = self.number, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = [number.setdefault(p, len(number)) for p in parts_of(text)]
                n[i] = len(own)
                codes.append(np.array(own, np.int64))
        self.learn()
        part = np.concatenate([*codes, np.zeros(0, np.int64)])
        at = np.concatenate(([0], np.cumsum(n)))
        spelt = between(self.bad[part], at) == 0
        part, n = part[np.repeat(spelt, n)], np.where(spelt, n, 0)
        at, lengths = np.concatenate(([0], np.cumsum(n))), self.lengths[part]
        token_at = np.concatenate(([0], np.cumsum(lengths)))
        out = self.flat[np.repeat(self.starts[part] - token_at[:-1], lengths) + np.arange(int(token_at[-1]))]
        texts_of, names = self.text, part.tolist()
        digests = [hashlib.sha256(b";".join([texts_of[p] for p in names[x:y]])).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out, token_at[at], digests


# ------------------------------------------------------------------ chunks

#: One table holds three kinds of rows: documents, entries of a chunk's dictionary, and pairs of ids with their documents.
KINDS = (
    "kind int, chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes array<int>, times array<int>, "
    "code int, grp string, a int, b int, docs bigint"
)
_TYPES = {
    "kind": pa.int32(), "chunk": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "codes": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "code": pa.int32(), "grp": pa.string(), "a": pa.int32(), "b": pa.int32(), "docs": pa.int64(),
}
DOCUMENT, ENTRY, PAIR = 0, 1, 2


def rows_of(kind: int, n: int, **cols) -> pa.RecordBatch:
    cols["kind"] = np.full(n, kind, np.int32)
    made = {c: pa.nulls(n, t) if c not in cols else cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c], t) for c, t in _TYPES.items()}
    return pa.record_batch(list(made.values()), list(made))


def distinct_codes(codes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    if 8 * len(codes) < groups:
        return np.unique(codes, return_counts=True)
    n = np.bincount(codes, minlength=groups)
    own = np.flatnonzero(n)
    return own, n[own]


class Chunk:
    """What a chunk of documents has used: groups, and in how many documents each pair of ids was linked."""

    def __init__(self):
        self.used, self.docs, self.place = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.entries = self.rows = 0

    def grow(self, d: Dictionary) -> None:
        """Room for all groups and pairs of the dictionary, with some to spare."""
        for name, n in (("used", len(d.keys)), ("docs", len(d.pair)), ("place", len(d.pair))):
            old = getattr(self, name)
            if len(old) < n:
                setattr(self, name, np.concatenate([old, np.zeros(n + n // 2 - len(old), old.dtype)]))

    def add(self, d: Dictionary, own: np.ndarray) -> None:
        """A document with these distinct groups."""
        self.used[own] = True
        n = d.pair_at[own + 1] - d.pair_at[own]
        before = np.cumsum(n) - n
        pairs = d.pairs[np.repeat(d.pair_at[own] - before, n) + np.arange(int(n.sum()))]
        order = np.arange(len(pairs))
        self.place[pairs] = order  # the last of equal pairs stays, so each counts once
        self.docs[pairs[self.place[pairs] == order]] += 1

    def end(self, d: Dictionary, chunk: int):
        own = np.flatnonzero(self.used)
        for k in range(0, len(own), 1 << 14):
            some = own[k : k + (1 << 14)]
            yield rows_of(ENTRY, len(some), chunk=np.full(len(some), chunk), code=some.astype(np.int32), grp=[d.keys[g] for g in some.tolist()])
        ids = np.fromiter(d.pair, np.int64, len(d.pair))
        own = np.flatnonzero(self.docs[: len(ids)])
        for k in range(0, len(own), 1 << 15):
            some = own[k : k + (1 << 15)]
            yield rows_of(PAIR, len(some), a=(ids[some] >> 32).astype(np.int32), b=(ids[some] & 0xFFFFFFFF).astype(np.int32), docs=self.docs[some])


_dictionaries: dict[tuple, Dictionary] = {}


def grouped(a: str | None, b: str | None):
    """(doc_id, text) -> the rows of KINDS."""

    def flow(batches):
        key, task, count = (a, b), TaskContext.get().partitionId(), 0
        if key not in _dictionaries:
            _dictionaries[key] = Dictionary(Tokens(a, b))
        d, chunk = _dictionaries[key], Chunk()
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, at, digests = d.groups_of(batch.column("text").to_pylist())
            chunk.grow(d)
            lists = []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own, times = distinct_codes(codes[x:y], len(d.keys)) if y > x else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                if y > x:
                    chunk.add(d, own)
                lists.append((own, times))
            n = np.array([len(x) for x, _ in lists], np.int64)
            ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            na, nb = d.a_len[codes], d.b_len[codes]
            columns = {"n_a": na, "n_b": nb, "n_groups": np.ones(len(codes), np.int64), "n_links": na * nb}
            yield rows_of(
                DOCUMENT, batch.num_rows, chunk=np.full(batch.num_rows, (task << 32) + count), doc_id=batch.column("doc_id"), groups_sha256=digests,
                codes=pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for x, _ in lists]).astype(np.int32))), times=pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for _, x in lists]).astype(np.int32))),
                **{c: between(x, at) for c, x in columns.items()},
            )
            chunk.entries, chunk.rows = chunk.entries + int(n.sum()), chunk.rows + batch.num_rows
            if chunk.entries > CHUNK_ENTRIES or chunk.rows > CHUNK_DOCS:
                yield from chunk.end(d, (task << 32) + count)
                chunk, count = Chunk(), count + 1
                if max(len(d.keys), len(d.pair)) > MOST_KEPT:
                    d = _dictionaries[key] = Dictionary(d.tokens)
        if chunk.rows:
            yield from chunk.end(d, (task << 32) + count)
        if max(len(d.keys), len(d.pair)) > MOST_KEPT:
            del _dictionaries[key]

    return flow


def valued(keys, documents: pa.Table, entries: pa.Table) -> pa.Table:
    """A chunk's documents with the values of their groups times frequencies."""
    code = entries.column("code").to_numpy()
    size = int(code.max()) + 1 if len(code) else 1
    column = documents.column("codes").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    times = documents.column("times").combine_chunks()
    times = times.chunk(0) if isinstance(times, pa.ChunkedArray) else times
    codes, times, at = column.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), np.asarray(column.offsets, np.int64)
    out = {c: documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    for name in ("n_best", "count_sum"):
        value = np.zeros(size, np.int64)
        value[code] = entries.column(name).to_numpy()
        out[name] = pa.array(between(value[codes] * times, at - at[0]), pa.int64())
    return pa.table(out | {"groups_sha256": documents.column("groups_sha256")})


def link_counts(rows: DataFrame) -> DataFrame:
    """(a, b, docs, top): in how many documents a pair of ids is linked, and the most that its A id has with any."""
    counts = materialize(rows.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("docs").alias("docs")), "link-counts")
    return counts.join(counts.groupBy("a").agg(F.max("docs").alias("top")), "a")


def group_values(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """groups(grp), each once -> (grp, n_best, count_sum) over its links."""
    sides = groups.select("grp", F.split("grp", r"\|").alias("s"))
    links = sides.select("grp", F.explode(F.split(F.col("s")[0], ",").cast("array<int>")).alias("a"), F.col("s")[1].alias("s"))
    links = links.select("grp", "a", F.explode(F.split("s", ",").cast("array<int>")).alias("b"))
    best = F.sum((F.col("docs") == F.col("top")).cast("bigint")).alias("n_best")
    return links.join(counts, ["a", "b"]).groupBy("grp").agg(best, F.sum("docs").alias("count_sum"))


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> one row a document, and the table of linked ids (a, b, docs, top)."""
    bounded_batches(docs.sparkSession)
    rows = materialize(docs.select("doc_id", "text").mapInArrow(grouped(a, b), KINDS), "groups")
    counts = materialize(link_counts(rows), "links")
    entries = rows.filter(F.col("kind") == ENTRY).select("chunk", "code", "grp")
    values = materialize(group_values(entries.select("grp").distinct(), counts), "group-values")
    entries = materialize(entries.join(values, "grp").select("chunk", "code", "n_best", "count_sum"), "entries")
    documents = rows.filter(F.col("kind") == DOCUMENT).select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")
    kind = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return documents.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInArrow(valued, kind), counts


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens of both kinds, groups, links and the counts of these links over the corpus."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
