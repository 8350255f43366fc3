"""Min-max near duplicates against all pairs of sets, and the signature's two promises."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import minmax as M
from tests.llm.cases import SCHEMA, documents, frame, words
from tests.llm.test_duplicates import roots


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or {tuple(w)} - {()}


def plain_rows(rows):
    sets = {i: plain_set(r[1]) for i, r in enumerate(rows)}
    some = [i for i in sets if sets[i]]
    links = []
    for k, i in enumerate(some):
        for j in some[k + 1 :]:
            a, b = sets[i], sets[j]
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                links.append((i, j))
    root, least = roots(range(len(rows)), links), {}
    for i, r in enumerate(rows):
        least.setdefault(root[i], []).append(r[0])
    out = Counter()
    for i, r in enumerate(rows):
        ids = [x for x in least[root[i]] if x is not None]
        c = min(ids) if ids else None
        out[r[0], len(sets[i]), c, c is None or r[0] == c] += 1
    return out


def edited(rng, base, most):
    w = base.split()
    for _ in range(rng.randint(0, most)):
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = [words(rng, 1)]
    return " ".join(w)


def row(i, text):
    return (i, text, "en", "s", None, "c", "c", "c")


@pytest.mark.parametrize("seed", [1, 2])
def test_op11_equals_all_pairs(spark, tmp_path, seed):
    rng, rows = random.Random(seed), documents(seed)
    for n in (3, 6, 12, 60, 200):
        base = words(rng, n)
        rows += [row(1000 + len(rows), edited(rng, base, max(1, n // 14))) for _ in range(30)]
    frame(spark, rows).withColumnRenamed("size", "content").withColumnRenamed("fp", "component_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op11_minmax(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == plain_rows(rows)


def test_groups_that_the_smallest_set_does_not_join(spark, tmp_path, monkeypatch):
    """Many texts just under the limit around a few hubs: blocks of sets are compared."""
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 3000)
    rng, base, rows = random.Random(5), words(random.Random(6), 150), []
    for _ in range(12):
        hub = edited(rng, base, 22)
        rows += [row(len(rows) + k, edited(rng, hub, 9)) for k in range(10)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(M, "block_pairs", lambda *a, f=M.block_pairs: seen.append(1) or f(*a))
    assert Counter(map(tuple, M.op11_minmax(spark, str(tmp_path)).collect())) == plain_rows(rows) and seen
    assert len({r[2] for r in plain_rows(rows)}) > 3


def test_signatures_meet_as_often_as_sets_do():
    assert M.bands_for() == 46 and (1 - 0.8**6) ** 46 < 1e-6
    rng = np.random.default_rng(1)
    for size in (1, 4, 40):
        least, equal = [], []
        for _ in range(150):
            both, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (8 * size, size, size))
            low, high = M.signatures([np.concatenate([both, a]), np.concatenate([both, b])], 138)
            equal.append((low[0] == low[1]).mean() / 2 + (high[0] == high[1]).mean() / 2)
            k = M.band_keys(low, high, 6)
            least.append((k[0] == k[1]).any())
            assert len(set(k.ravel().tolist())) == 92 - (k[0] == k[1]).sum()
        assert abs(np.mean(equal) - len(both) / (len(both) + len(a) + len(b))) < 0.02 and all(least)


def test_sets_hold_whole_texts_and_nothing_of_none():
    long = " ".join(f"w{i}" for i in range(50_000))
    got = M.hashed_sets(pa.array([long, "One", "one", "", None, "a b a b", "a b", "ab"]))
    assert [len(s) for s in got] == [49_999, 1, 1, 0, 0, 2, 1, 1] and got[1] == got[2] and got[6] != got[7]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op11_minmax(spark, str(tmp_path)).count() == 0
