"""Spelling variants against a plain search over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from parley.llm import spelling as S
from tests.llm.cases import SCHEMA, documents, frame


def plain_words(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if r[0] is None else r[0]}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def variants(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
    return out - {w}


def plain_forms(words):
    letters, out = sorted({c for w in words for c in w}), {}
    for w, n in words.items():
        near = variants(w, letters) & words.keys()
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if near and words[best] >= 10 * n else None, None, n, len(near), words[best] if near and words[best] >= 10 * n else None]
    for w, x in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        x[1] = root
    return {(w, *x) for w, x in out.items()}


def misspelt(rng):
    """Texts of words with one, two and three letters changed, chains of counts, repeated letters, capitals and long words."""
    letters, stems = "abàé", ["".join(rng.choice("abàé") for _ in range(rng.randint(7, 12))) for _ in range(25)] + ["a" * 8, "ab" * 5, "abcabcabca", "x" * 400]
    pool = Counter()
    for s in stems:
        pool[s] += 300
        for _ in range(12):
            w = s
            for k in range(rng.randint(1, 3)):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
                pool[w] += rng.choice([2, 3, 28, 30])
    bag = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, n in pool.items() for _ in range(n)]
    rng.shuffle(bag)
    return [(i, " ".join(bag[k : k + 60]) + ".", "en", None, None, "c", "c", "c") for i, k in enumerate(range(0, len(bag), 60))]


@pytest.mark.parametrize("seed", [0, 1])
def test_op12_equals_all_pairs(spark, tmp_path, seed):
    rows = [*documents(seed + 1), *misspelt(random.Random(seed))]
    frame(spark, rows).withColumnRenamed("size", "word").withColumnRenamed("fp", "form").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op12_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = Counter(map(tuple, got.collect())), Counter(plain_forms(plain_words(rows)))
    assert rows[0] == rows[1]
    assert sum(1 for r in rows[0] if r[1]) > 100 and any(r[1] and r[1] != r[2] for r in rows[0])


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 500)
    rng = random.Random(3)
    words = {"qz" + "".join(rng.choice("ab") for _ in range(rng.randint(6, 8))): rng.randint(2, 90) for _ in range(400)}
    got = S.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    assert Counter(map(tuple, got.collect())) == Counter(plain_forms(words))


def test_one_edit_and_empty_tables(spark, tmp_path):
    assert S.one_edit(b"abcdefg", b"abcdefgh") and S.one_edit(b"xbcdefg", b"abcdefg") and S.one_edit(b"aab", b"ab")
    assert not S.one_edit(b"abcdefg", b"abcdefg") and not S.one_edit(b"ba", b"ab") and not S.one_edit(b"abcd", b"ab")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op12_spelling_variants(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(1, "nothing"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert S.op12_spelling_variants(spark, f"{tmp_path}/one").count() == 0
