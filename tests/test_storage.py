"""Digest trees, commits, revisions and projections: order, NULLs, reruns, failures and untouched files."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.operators import commits as C
from parley.operators import digests as D
from parley.operators.percentiles import nearest_ranks
from parley.operators.storage import Files, numbered


def plain_tree(rows, fanout):
    """(level, node, n_rows, digest) over (id, content) in the given order."""

    def line(i, c):
        return f"{len(str(i))}:{i}" + ("N;" if c is None else f"S{len(c)}:{c};")

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    now, out, level = [(1, sha(line(i, c))) for i, c in rows], set(), 1
    while True:
        now = [(sum(n for n, _ in now[k : k + fanout]), sha("".join(h for _, h in now[k : k + fanout]))) for k in range(0, len(now), fanout)]
        out |= {(level, k, n, h) for k, (n, h) in enumerate(now)}
        if len(now) <= 1:
            return out
        level += 1


def rows_of(n):
    return [(i, None if i % 11 == 0 else "" if i % 7 == 0 else f"text {i} é") for i in range(n)]


@pytest.mark.parametrize(("n", "fanout"), [(0, 4), (3, 4), (64, 4), (100, 4)])
def test_tree_equals_plain_hashing(spark, tmp_path, n, fanout):
    df = spark.createDataFrame(rows_of(n)[::-1], "id bigint, content string").repartition(3)
    found = D.write_verified(df, f"{tmp_path}/out", "id", "content", fanout)
    want = plain_tree(rows_of(n), fanout) if n else set()
    assert {tuple(r) for r in found.collect()} == want
    if n:
        assert D.roots(found).first().n_rows == n


def test_null_empty_and_swapped_rows_are_found(spark, tmp_path):
    rows = rows_of(50)
    trees = {}
    for name, own in {"right": rows, "null": [(i, "" if i == 11 else c) for i, c in rows], "swapped": [*rows[:20], rows[21], rows[20], *rows[22:]], "short": rows[:-1]}.items():
        spark.createDataFrame(own, "id bigint, content string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        trees[name] = D.stored_tree(spark, f"{tmp_path}/{name}", "id", "content", 4)
    where = {name: {r.node for r in D.differing(trees["right"], t).filter("level = 1").collect()} for name, t in trees.items()}
    assert where == {"right": set(), "null": {2}, "swapped": {5}, "short": {12}}


def test_write_verified_refuses_what_differs(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows_of(30), "id bigint, content string")
    whole = D.stored_tree
    monkeypatch.setattr(D, "stored_tree", lambda s, path, *a: whole(s, f"{tmp_path}/other", *a))
    spark.createDataFrame([(i, c or "") for i, c in rows_of(30)], "id bigint, content string").coalesce(1).write.parquet(f"{tmp_path}/other")
    with pytest.raises(D.PayloadMismatch, match=r"runs \[0, 2, 5\]"):
        D.write_verified(df, f"{tmp_path}/out", "id", "content", 4)


def test_groups_have_trees_of_their_own(spark):
    rows = [(g, i, f"{g}{i}") for g, n in (("a", 40), ("b", 3), (None, 9)) for i in range(n)]
    ranked = D.in_order(spark.createDataFrame(rows, "g string, i int, c string").select("g", "i", D.payload("i", "c").alias("digest")).repartition(5), ["i"], ["g"])
    got = {r.g: (r.n_rows, r.digest) for r in D.roots(D.tree(ranked, by=["g"], fanout=4), ["g"]).collect()}
    for g, n in (("a", 40), ("b", 3), (None, 9)):
        top = max(plain_tree([(i, f"{g}{i}") for i in range(n)], 4))
        assert got[g] == (n, top[3])


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_tree_over_hashed_ids(spark, depth):
    rows = [(g, f"i{i}", f"d{i}{g}") for g in "ab" for i in range(60)]
    got = {r.g: (r.n_rows, r.digest) for r in D.id_roots(spark.createDataFrame(rows, "g string, id string, digest string").repartition(4), ["g"], depth).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for g in "ab":
        nodes = {}
        for _, i, x in sorted((sha(i), i, x) for h, i, x in rows if h == g):
            nodes.setdefault(sha(i)[:depth], []).append(x)
        for k in range(depth - 1, -2, -1):
            above = {}
            for n in sorted(nodes):
                above.setdefault(n[: max(k, 0)], []).append(sha("".join(nodes[n])))
            nodes = above
        assert got[g] == (60, nodes[""][0])


def test_numbered_follows_files(spark, tmp_path):
    spark.range(1000).repartition(7).sortWithinPartitions("id").write.parquet(f"{tmp_path}/x")
    got = [r.rank for r in numbered(spark, f"{tmp_path}/x").collect()]
    assert sorted(got) == list(range(1000))


# ------------------------------------------------------------------ commits

KIND = "k bigint, j string, v string, at int"


def files_under(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_merge_keeps_untouched_buckets_and_reruns_change_nothing(spark, tmp_path):
    t = C.CommitTable(spark, f"file://{tmp_path}/t", ["k", "j"], 8)
    with pytest.raises(ValueError, match="no version yet"):
        t.read()
    first = [(i, None if i % 5 == 0 else "x", f"v{i}", 1) for i in range(60)] + [(None, None, "nulls", 1), (None, "x", None, 1)]
    assert t.merge(spark.createDataFrame(first, KIND), "one") == 1
    before = files_under(tmp_path)
    second = [(5, None, "new", 2), (5, None, "newer", 3), (None, None, "still one", 2), (77, "x", None, 2)]
    assert t.merge(spark.createDataFrame(second, KIND), "two", ["at"]) == 2
    want = {(k, j): (v, a) for k, j, v, a in first} | {(5, None): ("newer", 3), (None, None): ("still one", 2), (77, "x"): (None, 2)}
    assert {(r.k, r.j): (r.v, r["at"]) for r in t.read().collect()} == want and t.read().count() == len(want)
    assert {(r.k, r.j): (r.v, r["at"]) for r in t.read(1).collect()} == {(k, j): (v, a) for k, j, v, a in first}
    assert before <= files_under(tmp_path)
    now = t.manifest()["current"]
    assert {c.split("-")[1] for c in now.values()} == {"one", "two"}
    after = files_under(tmp_path)
    assert t.merge(spark.createDataFrame(first, KIND), "one") == 2 and t.merge(spark.createDataFrame(second, KIND), "two") == 2
    assert after == files_under(tmp_path)
    with pytest.raises(ValueError, match="columns"):
        t.merge(spark.createDataFrame([(1, "x")], "k bigint, j string"), "three")


def test_a_failed_or_second_writer_changes_nothing(spark, tmp_path, monkeypatch):
    t = C.CommitTable(spark, f"file://{tmp_path}/t", ["k"], 4)
    t.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string"), "one")
    broken = spark.createDataFrame([(1, "z")], "k bigint, v string").withColumn("v", F.when(F.col("k") == 1, F.raise_error(F.lit("no"))).otherwise("z"))
    with pytest.raises(Exception, match="no"):
        t.merge(broken, "two")
    # Data files written, version file not: what was stays current, and the same batch may be run again.
    publish = Files.publish
    monkeypatch.setattr(Files, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        t.merge(spark.createDataFrame([(1, "z")], "k bigint, v string"), "two")
    monkeypatch.setattr(Files, "publish", publish)
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "b")} and t.versions() == [1]
    # Another writer makes version 2 first.
    base = t.manifest()
    assert t.merge(spark.createDataFrame([(2, "y")], "k bigint, v string"), "other") == 2
    monkeypatch.setattr(t, "manifest", lambda version=None: base)
    with pytest.raises(C.CommitConflict):
        t.merge(spark.createDataFrame([(1, "z")], "k bigint, v string"), "two")
    monkeypatch.undo()
    assert t.merge(spark.createDataFrame([(1, "z")], "k bigint, v string"), "two") == 3
    assert {tuple(r) for r in t.read().collect()} == {(1, "z"), (2, "y")}


def test_delete_and_update(spark, tmp_path):
    t = C.CommitTable(spark, f"file://{tmp_path}/t", ["k"], 8)
    t.merge(spark.range(40).select(F.col("id").alias("k"), F.lit("v").alias("v")), "one")
    assert t.delete(spark.createDataFrame([(3,), (4,), (99,)], "k bigint"), "two") == 2
    assert {r.k for r in t.read().collect()} == set(range(40)) - {3, 4}
    assert t.update({"v": F.lit("w")}, F.col("k") == 7, "three") == 3
    assert {r.k for r in t.read().filter("v = 'w'").collect()} == {7} and t.read().count() == 38
    held = files_under(tmp_path)
    assert t.update({"v": F.lit("u")}, F.col("k") == 700, "four") == 3 and held == files_under(tmp_path)
    t.delete(spark.range(40).select(F.col("id").alias("k")), "five")
    assert t.read().count() == 0 and t.manifest()["current"] == {}


def test_revisions_switch_back_and_rerun(spark, tmp_path):
    t, kind = C.revision_table(spark, f"file://{tmp_path}/t", 4), "dialogue bigint, parser string, body string"

    def current():
        return {r.dialogue: r.body for r in t.read().filter("is_current").collect()}

    C.write_revisions(t, spark.createDataFrame([(1, "p", "a"), (2, "p", None), (None, "p", "n")], kind), "one")
    assert current() == {1: "a", 2: None, None: "n"}
    C.write_revisions(t, spark.createDataFrame([(1, "p", "b"), (2, "p", ""), (3, "p", "c")], kind), "two")
    assert current() == {1: "b", 2: "", 3: "c", None: "n"} and t.read().count() == 6
    assert C.write_revisions(t, spark.createDataFrame([(1, "p", "b")], kind), "same") == 2
    C.write_revisions(t, spark.createDataFrame([(1, "p", "a"), (None, "p", "n")], kind), "back")
    assert current() == {1: "a", 2: "", 3: "c", None: "n"} and t.read().count() == 6
    assert t.read().groupBy("dialogue").agg(F.count_if("is_current").alias("n")).filter("n <> 1").count() == 0


def test_set_digests_tell_texts_apart_in_any_order(spark):
    rows = [(i, None if i == 11 else f"t{i % 7}") for i in range(40)]
    cases = {"right": rows, "turned": rows[::-1], "null": [(i, "" if i == 11 else c) for i, c in rows], "swapped": [*rows[:20], (20, rows[21][1]), (21, rows[20][1]), *rows[22:]], "short": rows[:-1], "twice": [*rows, rows[0]]}
    frame = spark.createDataFrame([(k, *r) for k, v in cases.items() for r in v], "g string, id bigint, content string").repartition(5)
    out = D.set_digests(frame.select("g", D.payload("id", "content").alias("digest")), ["g"])
    got = {r.g: (r.n_rows, r.digest) for r in out.collect()}
    assert got["right"] == got["turned"] and len(set(got.values())) == 5 and got["short"][0] == 39
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()  # sums only: rows aren't moved


def test_revisions_move_bodies_once(spark, tmp_path, monkeypatch):
    t, kind = C.revision_table(spark, f"file://{tmp_path}/t", 4), "dialogue bigint, parser string, body string"
    plans, commit = [], C.CommitTable._commit
    monkeypatch.setattr(C.CommitTable, "_commit", lambda self, changed, *more: plans.append(changed._jdf.queryExecution().executedPlan().toString()) or commit(self, changed, *more))
    C.write_revisions(t, spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (1, "p", "c"), (1, "q", "a"), (None, "p", None)], kind), "one")
    C.write_revisions(t, spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "p", "x"), (1, "p", "d")], kind), "two")
    assert C.write_revisions(t, spark.createDataFrame([(9, "p", "other")], kind), "two") == 2  # a known token changes nothing, whatever it comes with
    assert [p.split("+- == Initial")[0].count("Exchange") for p in plans] == [1, 1]
    hashed = lambda b: hashlib.sha256(b"N" if b is None else b"S" + b.encode()).hexdigest()
    id_ = lambda d, p, b: "rev_" + hashlib.sha256("\0".join([*([] if d is None else [str(d)]), p, hashed(b)]).encode()).hexdigest()[:24]
    first = max([("p", "a"), ("p", "c"), ("q", "a")], key=lambda x: (hashed(x[1]), id_(1, *x)))
    second = max([("p", "a"), ("p", "d")], key=lambda x: hashed(x[1]))
    want = {(1, *first, first == second), (1, *second, True), (2, "p", "b", True), (3, "p", "x", True), (None, "p", None, True)}
    assert {(r.dialogue, r.parser, r.body, r.is_current) for r in t.read().collect()} == want and t.read().count() == len(want)


def test_projection_replaces_only_given_revisions(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    rows = spark.createDataFrame([(f"r{i}", i, f"t{i}") for i in range(30) for _ in range(2)], "revision string, n int, t string")
    C.replace_projection(spark, path, rows, rows.select("revision"), parts=8)
    before = files_under(tmp_path)
    new = spark.createDataFrame([("r3", 300, "new"), ("r9", 9, "ignored")], "revision string, n int, t string")
    gone = spark.createDataFrame([("r3",), ("r4",)], "revision string")
    C.replace_projection(spark, path, new, gone, parts=8)
    got = sorted((r.revision, r.n, r.t) for r in spark.read.parquet(path).collect())
    assert got == sorted([(f"r{i}", i, f"t{i}") for i in range(30) if i not in (3, 4) for _ in range(2)] + [("r3", 300, "new")])
    touched = {f.split("/")[1] for f in files_under(tmp_path) ^ before}
    assert len(touched) <= 2 and len(before & files_under(tmp_path)) > 0
    one = spark.createDataFrame([("only", 1, "x")], "revision string, n int, t string")
    C.replace_projection(spark, f"file://{tmp_path}/q", one, one.select("revision"), parts=8)
    C.replace_projection(spark, f"file://{tmp_path}/q", one.limit(0), one.select("revision"), parts=8)
    assert not files_under(f"{tmp_path}/q")


def test_percentiles_equal_sorting(spark):
    import math
    import random

    rng, rows = random.Random(3), []
    for g in ("a", "b", None, "c"):
        rows += [(g, None if rng.random() < 0.1 else float(rng.choice([1, 1, 1, 2, 5, rng.random()]))) for _ in range({"c": 1}.get(g, 300))]
    rows.append(("none", None))
    got = {r.g: (r.low, r.mid, r.high) for r in nearest_ranks(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", {"low": 0.0, "mid": 0.5, "high": 0.95}).collect()}
    for g in {r[0] for r in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got.get(g) == (tuple(v[max(math.ceil(p * len(v) - 1e-9), 1) - 1] for p in (0.0, 0.5, 0.95)) if v else None)
