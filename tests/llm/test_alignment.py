"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from parley.llm import alignment as A
from tests.llm.cases import SCHEMA, documents, frame, words

ODD = [
    " two  spaces", "tab\there \n and  \n\n lines \n", "\n", " ", "  ", "a ", "▁piece ▁", "x ▁y", "<|endoftext|> </s> <unk> <0x41>", "nul\0 byte", "日本語のテキスト and 漢字 🙂🙃 👩‍👩‍👧", "café café ﬁ",
    " no break space em", "it's they've I'll we'd", "x" * 3000, "ab1" * 900, "\r\n\r\n x\ry", "﻿mark", "\x1c \x85 a", "{\r\n}\r\n", "123 4567 89 0", "a" + " " * 300 + "b",
]


@pytest.fixture(scope="module")
def tokens():
    return A.Tokens()


def plain_groups(tokens, text):
    """(A ids, B ids) of each group, over the whole text; none if the bytes differ."""
    if not text:
        return []
    a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    want = b" " + text.encode()
    if b"".join(tokens.a_bytes[i] for i in a) != want or b"".join(tokens.b_bytes[i] for i in b) != want:
        return []
    out, x, y, i, j = [], [], [], 0, 0
    while a or b:
        if i <= j:
            x.append(a.pop(0))
            i += len(tokens.a_bytes[x[-1]])
        else:
            y.append(b.pop(0))
            j += len(tokens.b_bytes[y[-1]])
        if i == j:
            out.append((x, y))
            x, y = [], []
    return out


def plain_rows(tokens, rows):
    groups = [plain_groups(tokens, r[1]) for r in rows]
    docs = Counter(p for own in groups for p in {(i, j) for x, y in own for i in x for j in y})
    top = defaultdict(int)
    for (i, _), n in docs.items():
        top[i] = max(top[i], n)
    out = Counter()
    for r, own in zip(rows, groups, strict=True):
        links = [(i, j) for x, y in own for i in x for j in y]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        out[
            r[0], sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if own else "",
        ] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_op13_equals_whole_texts(spark, tmp_path, tokens, monkeypatch, chunk):
    rows = documents(4) + [(500 + i, t, "en", None, None, "c", "c", "c") for i, t in enumerate(ODD)]
    rows += [(600 + i, " ".join(words(random.Random(i % 3), 40).split()[::-1]), "en", None, None, "c", "c", "c") for i in range(6)]
    frame(spark, rows).withColumnRenamed("size", "chunk").withColumnRenamed("fp", "codes").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(A, "CHUNK_ENTRIES", chunk)
    got = A.op13_alignment(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == plain_rows(tokens, rows)


def test_tables_are_forgotten_without_a_trace(tokens, monkeypatch):
    """Bounded caches change nothing: groups of a text are the same however often parts are forgotten."""
    monkeypatch.setattr(A, "CACHE_PARTS", 20)
    d = A.Dictionary(tokens)
    for text in [*ODD, words(random.Random(1), 300), "of the " * 50]:
        codes, at, digest = d.groups_of([text, None, text])
        want = plain_groups(tokens, text)
        assert [d.keys[c] for c in codes[: at[1]]] == [f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want]
        assert at[1] == at[2] and digest[1] == "" and digest[0] == digest[2]


def test_parts_put_together_are_the_text():
    for text in ODD:
        assert " ".join(A.parts_of(text)) == text


def test_link_table_and_empty_tables(spark, tmp_path, tokens):
    rows = [(1, "the cat"), (2, "the cat the cat"), (3, None), (4, "a hat")]
    _, counts = A.align(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = Counter(p for _, t in rows for p in {(i, j) for x, y in plain_groups(tokens, t) for i in x for j in y})
    assert {(r.a, r.b): r.docs for r in counts.collect()} == dict(want)
    for name, rows in (("none", []), ("blank", [(1, None), (None, "")])):
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = A.op13_alignment(spark, f"{tmp_path}/{name}").collect()
        assert Counter(map(tuple, got)) == Counter((i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows)
    assert public_tokenizers.path(A.A_VOCABULARY) and SCHEMA
