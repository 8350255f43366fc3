"""SimHash links, components, repeated strings and benchmark leaks against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from parley.llm import decontamination as D
from parley.llm import near_copies as N
from parley.llm import repeats as P
from parley.llm import simhash as H
from parley.llm.components import connected_components, star_edges
from tests.llm.cases import documents, frame, words


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3), (3, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "src bigint, dst bigint"), "src", "dst").collect()}
    want = roots({x for e in links for x in e}, links)
    assert got == {n: r for n, r in want.items() if n != 200}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint"), "src", "dst").count() == 0


def test_star_edges_keep_components():
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    a, b = star_edges(np.array([x for x, _ in links]), np.array([y for _, y in links]))
    assert roots(range(300), links) == roots(range(300), zip(a.tolist(), b.tolist(), strict=True)) and len(a) < 300


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_op7_equals_brute_force(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = H.op7_simhash(spark, str(tmp_path)).collect()
    rows = [(r[0], plain_fingerprint(r[1])) for r in documents()]
    prints = sorted({p for _, p in rows})
    root = roots(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, p in rows:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{p:016x}", least[root[p]]) for i, p in rows)
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert H.op7_simhash(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(("radius", "dense"), [(0, 0), (2, 300), (4, 300), (7, 120)])
def test_links_equal_brute_force_in_dense_and_sparse_groups(spark, radius, dense):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = {*(rng.getrandbits(64) for _ in range(300)), *seeds}
    for s in seeds[:3]:
        prints |= {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius))) for _ in range(dense)}
    prints |= {s ^ sum(1 << b for b in rng.sample(range(64), radius + 1)) for s in seeds}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "node bigint, fp bigint")
    links = [(r.src, r.dst) for r in H.link_fingerprints(nodes, radius).collect()]
    want = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius]
    assert roots(range(len(prints)), links) == roots(range(len(prints)), want)


def test_plan_spends_the_radius():
    sample = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for radius in (0, 3, 8):
        for n in (10, 10**6, 10**9):
            plan = H.make_plan(sample, n, radius)
            assert sum(t + 1 for t in plan.thresholds) == radius + 1 and sorted(b for g in plan.groups for b in g) == list(range(64))


def near(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


def test_near_copies_leave_one_of_each_group(spark):
    rng = random.Random(9)
    base = [words(rng, 200) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, near(rng, t, 2)) for i, t in enumerate(base[:20])] + [(200 + i, base[0]) for i in range(5)] + [(200, base[0]), (None, base[1]), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, fp string")
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter([*range(30), None])
    assert N.drop_near_copies(docs.limit(0)).count() == 0


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b) - 1e-12


def edited(rng, text, kind, share):
    """The text with about ``share`` of it changed in one of five ways."""
    w = text.split()
    n = max(1, int(len(w) * share))
    new = words(rng, n).split()
    at = rng.randrange(len(w) - n)
    if kind == "scattered":
        for i in rng.sample(range(len(w)), max(1, n // 5)):
            w[i] = new[0]
        return " ".join(w)
    return " ".join({"appended": w + new, "cut": w[:-n], "replaced": w[:at] + new + w[at + n :], "inserted": w[:at] + new + w[at:]}[kind])


KINDS = ("scattered", "appended", "cut", "replaced", "inserted")


def edited_corpus(seed, lengths=(80, 600)):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(*lengths)) for _ in range(60)]
    return base + [edited(rng, t, KINDS[i % 5], s) for i, t in enumerate(base) for s in (0.06, 0.1, 0.14, 0.18, 0.22, 0.3)]


def test_near_copies_found_equal_brute_force(spark):
    texts = edited_corpus(21) + [None, "", "few words only", "Few words  only"]
    sets = [plain_shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])]
    root = roots(range(len(texts)), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len(pairs) > 60 and {r.doc_id for r in N.drop_near_copies(docs).collect()} == set(root.values())


def test_texts_under_the_limit_are_no_copies(spark):
    rng = random.Random(22)
    rows = []
    for i in range(300):
        text = words(rng, rng.randint(80, 400))
        other = edited(rng, text, KINDS[i % 5], rng.choice((0.12, 0.16, 0.2, 0.24)))
        a, b = plain_shingles(text), plain_shingles(other)
        if 0.7 <= len(a & b) / len(a | b) <= 0.9:
            rows += [(2 * i, text), (2 * i + 1, other)]
    apart = {i for (i, t), (_, u) in zip(rows[1::2], rows[::2], strict=True) if not alike(plain_shingles(t), plain_shingles(u))}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in N.drop_near_copies(docs).collect()}
    assert len(apart) > 30 and {i for i in kept if i % 2} == apart and {i for i in kept if not i % 2} == {i for i, _ in rows[::2]}


def plain_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)) == 1)
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [P.MOST_CONTEXTS, 2])
def test_op5_equals_brute_force(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(P, "MOST_CONTEXTS", most)
    monkeypatch.setattr(P, "MERGE_BYTES", 3000)
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = documents()
    want = Counter((r[0], *x) for r, x in zip(rows, plain_repeats([r[1] for r in rows]), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in P.op5_suffix_array_dedup(spark, str(tmp_path)).collect())
    assert got == want
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.op5_suffix_array_dedup(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_merged_transforms_find_repeated_starts(seed):
    rng = random.Random(seed)
    pool = [bytes(rng.choice(b"ab\x00") for _ in range(300)) for _ in range(3)] + [b"z" * 400]
    texts = [p[rng.randrange(0, 60) :] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 90))) for p in pool for _ in range(3)]
    starts = [max(1, min(len(t) - 199, rng.randrange(1, 200))) for t in texts]
    mult = np.array([rng.choice((1, 2)) for _ in texts])
    n = Counter()
    for t, s, m in zip(texts, starts, mult.tolist(), strict=True):
        for p in range(s):
            n[t[p : p + 200]] += m
    want = [[p for p in range(s) if n[t[p : p + 200]] > 1] for t, s in zip(texts, starts, strict=True)]
    for shards in (1, 2, 5):
        assert [x.tolist() for x in P.repeated_starts(texts, starts, mult, shards)] == want


def test_anchor_places_are_those_of_the_content():
    rng = np.random.default_rng(2)
    a = rng.integers(97, 100, 150_000).astype(np.uint8)
    at = P.anchor_places(a)
    assert len(at) == len(a) - 199 and (at >= np.arange(len(at))).all() and (at <= np.arange(len(at)) + 136).all()
    part = P.anchor_places(a[70_000:90_000])
    assert (part + 70_000 == at[70_000 : 70_000 + len(part)]).all()


def test_leaks_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    items = [words(rng, n) for n in (1, 3, 5, 12, 40, 40)] + ["", None, "Ünï ünï"]
    docs = documents()
    docs += [(900 + i, words(rng, 500) + " " + (t or "").upper() + ", " + words(rng, 500), None, None, None, None, None, None) for i, t in enumerate(items)]
    docs.append((950, " ".join(items[4].split()[:34]) + " " + words(rng, 9), None, None, None, None, None, None))
    docs.append((951, " ".join(items[4].split()[:20]), None, None, None, None, None, None))
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = Counter()
    for r in docs:
        w = D.words_of(r[1])
        for i, t in enumerate(items):
            own = D.shingles_of(D.words_of(t))
            if own:
                k = len(next(iter(own)))
                n = len(own & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
                if n >= 0.8 * len(own):
                    want[r[0], i, len(own), n] += 1
    got = D.op4_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got) == want and (950, 4) in {(a, b) for a, b, *_ in want}
    leaks = {a for a, *_ in want}
    table, bench = frame(spark, docs), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    kept = D.drop_leaks(table, bench, block=2)
    assert kept.columns == table.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in docs if r[0] not in leaks)
    assert D.find_leaks(table.limit(0), bench).count() == 0 and D.find_leaks(table, bench.limit(0)).count() == 0


def test_size_classes_and_bands():
    bounds = [D.size_class(n) for n in range(1, 200)]
    assert all(n <= u <= max(n, 1.5 * n) for n, u in enumerate(bounds, 1)) and bounds == sorted(bounds)
    assert sorted(set(bounds))[:9] == [1, 2, 3, 4, 6, 8, 12, 16, 24]
    assert (1 - 0.3) ** D.bands_for(0.3) <= D.MISS < (1 - 0.3) ** (D.bands_for(0.3) - 1)


def test_search_recall_over_long_documents():
    rng = random.Random(6)
    items = [words(rng, n) for n in (5, 6, 8, 11, 17, 30, 44, 90, 200, 400) for _ in range(6)]
    pool = [w for t in items for w in t.split()]
    index = D.ItemIndex(list(enumerate(items)))
    texts, want = [], []
    for _ in range(400):
        i = rng.randrange(len(items))
        w = items[i].split()
        for _ in range(len(w) // 60):
            w[rng.randrange(len(w))] = "changed"
        around = [" ".join(rng.choice(pool) for _ in range(rng.randrange(3000))) for _ in range(2)]  # words of items, shuffled
        text = f"{around[0]} {' '.join(w)} {around[1]}"
        texts.append(text)
        own, have = D.shingles_of(D.words_of(items[i])), D.shingles_of(D.words_of(text))
        want.append((i, len(own & have) >= 0.8 * len(own)))
    got = index.search(texts)
    hits = [i in {x[0] for x in g} for g, (i, ok) in zip(got, want, strict=True) if ok]
    assert len(hits) > 300 and all(hits)
    # The classes work: each alone finds its own items, and none of another class.
    (classes,) = index.classes.values()
    for c in list(classes):
        index.classes[5] = [c]
        alone = {x[0] for g in index.search(items) for x in g}
        assert alone == {int(r) for r in c.minima[0][1]}
    assert len(classes) > 5


def test_items_without_an_id_are_items(spark):
    rng = random.Random(5)
    items = [(None, words(rng, 30)), (1, words(rng, 30)), (None, words(rng, 7)), (None, None)]
    rows = [(i, words(rng, 40) + " " + (t or "") + " " + words(rng, 40)) for i, (_, t) in enumerate(items)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (20_000, 1):
        found = D.find_leaks(docs, bench, block=block).collect()
        assert Counter((r.doc_id, r.item_id, r.n_found) for r in found) == Counter([(0, None, 26), (1, 1, 26), (2, None, 3)])
        assert [r.doc_id for r in D.drop_leaks(docs, bench, block=block).collect()] == [3]
