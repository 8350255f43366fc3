"""Scalar functions and operators on hand-made rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from parley.functions import models as M
from parley.functions import numbers as N
from parley.functions import texts as T
from parley.operators import export as X
from parley.operators import impute as I
from parley.operators import lineage as L
from parley.operators import reconcile as R
from parley.operators import segments as G
from parley.operators import sequences as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("openai/gpt-5.5-high", ("openai", "gpt-5.5", "high", "openai")), (" claude-opus-5 ", ("anthropic", "claude-opus-5", None, None)), ("kimi-code/k2", ("moonshot", "k2", None, "kimi-code")),
        ("foo/qwen3-XHIGH", ("alibaba", "qwen3", "XHIGH", "foo")), ("o3-mini", ("openai", "o3-mini", None, None)), ("/odd", ("unknown", "/odd", None, None)), ("high", ("unknown", "high", None, None)),
    ],
)
def test_model_names(spark, raw, want):
    assert tuple(one(spark, M.normalize_model_name(F.lit(raw)))) == want


def test_costs(spark):
    rows = [("openai/gpt-5.5", 1000, 400, 100, 10), ("openai/gpt-5.5", 300_000, 0, 0, 10), ("openai/gpt-5.5", 100, 90, 20, 0), ("none/x", 5, 0, 0, 5), ("alibaba/qwen3-coder-next:cloud", 32_000, 0, 0, 0), ("alibaba/qwen3-coder-next:cloud", 32_001, None, None, None)]
    df = spark.createDataFrame(rows, "k string, i long, c long, w long, o long")
    got = [(r.k, r.i, round(r.total_cost, 9), r.priced, r.unpriced_tokens) for r in M.with_cost(df, M.price_table(spark), "k", "i", "c", "w", "o").collect()]
    want = [
        ("openai/gpt-5.5", 1000, round((500 * 5 + 400 * 0.5 + 100 * 5 + 10 * 30) / 1e6, 9), True, 0), ("openai/gpt-5.5", 300_000, round((300_000 * 10 + 10 * 45) / 1e6, 9), True, 0),
        ("openai/gpt-5.5", 100, round(500 / 1e6, 9), True, 0), ("none/x", 5, 0.0, False, 10), ("alibaba/qwen3-coder-next:cloud", 32_000, round(32_000 * 0.3 / 1e6, 9), True, 0), ("alibaba/qwen3-coder-next:cloud", 32_001, round(32_001 * 0.5 / 1e6, 9), True, 0),
    ]
    assert sorted(got) == sorted(want)


def test_numbers(spark):
    nan = float("nan")
    got = spark.createDataFrame([(1.9,), (-1.9,), (nan,), (None,), (float("inf"),)], "v double").select(N.safe_integer(F.col("v")).alias("i"), N.positive(F.col("v")).alias("p"), N.round6(F.col("v")).alias("r")).collect()
    assert [r.i for r in got] == [1, -1, 0, 0, 0] and [r.p for r in got][:4] == [1.9, 0, 0, 0] and [r.r for r in got] == [1.9, -1.9, None, None, None]
    values = spark.createDataFrame([(v,) for v in (4, 1, 3, 2)], "v long")
    assert [values.agg(N.nearest_rank("v", p)).first()[0] for p in (0.5, 0.9)] == [2, 4]
    assert one(spark, N.lower_quantile(F.array(*map(F.lit, (1, 2, 3, 4))), 0.9)) == 3
    assert [one(spark, N.backoff_ms(F.lit(n))) for n in (1, 2, 30)] == [10_000, 20_000, 3_600_000]
    assert one(spark, N.bounded_cache_share(F.lit(10), F.lit(11))) is None


def test_texts(spark):
    assert one(spark, T.analyze(F.lit("camelCase HTTPServer Ünï 42x 漢字"))) == ["camel", "case", "https", "erver", "ünï", "42", "x", "漢字"]
    assert one(spark, T.worked_for_ms(F.lit("Worked for 1h 2m 3s."))) == 3_723_000 and one(spark, T.worked_for_ms(F.lit("idle"))) is None
    assert one(spark, T.workspace_path(F.lit("/"))) == "/" and one(spark, T.workspace_path(F.lit("/a/b//"))) == "/a/b"
    assert [one(spark, F.unix_millis(T.parse_timestamp(F.lit(x)))) for x in ("1700000000", "1700000000000", "2023-11-14T22:13:20Z", "x", "99")] == [1_700_000_000_000] * 3 + [None, None]
    assert one(spark, T.report_project(F.lit(" "), F.lit(None))) == "unassigned"


def test_turns_and_runs(spark):
    rows = spark.createDataFrame([("a", i, b) for i, b in enumerate([0, 1, 0, 1, 0])], "k string, i long, b int")
    assert [r.turn_no for r in S.turns(rows, "k", "i", F.col("b") == 1).orderBy("i").collect()] == [0, 1, 1, 2, 2]
    pairs = spark.createDataFrame([("x", i, i + 2) for i in (1, 2, 3)] + [("x", i, i) for i in (5, 6)], "k string, i long, j long")
    assert [tuple(r) for r in S.longest_runs(pairs, "k", "i", "j").collect()] == [("x", 3, 1, 3)]
    times = spark.createDataFrame([("a", t) for t in (0, 0, 1000, 500_000, 500_100)], "k string, ms long")
    assert S.active_time(times, "k", "ms", 180_000).first().active_ms == 1100
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 7), ("a", 10, 12)], "k string, s long, e long")
    assert S.max_concurrent(spans, "k", "s", "e").first().max_open == 2


def test_reconcile_presence(spark):
    f = "struct<sha256:string,size_bytes:long,mtime_ms:long,head_hash:string>"
    before = spark.createDataFrame([("a", "active", 0, ("1", 1, 1, None)), ("b", "active", 0, ("2", 1, 1, None)), ("c", "missing", 2, ("3", 1, 1, None)), ("d", "deleted", 5, (None, 1, 1, "h"))], f"path string, presence string, missed int, f {f}")
    now = spark.createDataFrame([("a", ("1", 9, 9, None)), ("b", ("x", 1, 1, None)), ("d", (None, 1, 1, "h")), ("e", (None, 1, 1, None))], f"path string, f {f}")
    got = {r.path: tuple(r)[1:] for r in R.reconcile(before, now, "path", True).collect()}
    assert got == {"a": ("unchanged", "active", 0), "b": ("changed", "active", 0), "c": ("missing", "deleted", 3), "d": ("returned", "active", 0), "e": ("new", "active", 0)}
    part = {r.path: tuple(r)[1:] for r in R.reconcile(before, now, "path", False).collect()}
    assert part["c"] == ("unknown", "missing", 2)


def test_renames_need_one_candidate(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    got = R.renames(files([("a", "1"), ("b", "2"), ("c", "3")]), files([("x", "1"), ("y", "2"), ("z", "2"), ("w", "3")]), files([("q", "3")]))
    assert [tuple(r) for r in got.collect()] == [("1", "a", "x")]


def test_batches_lease_and_split(spark):
    items = spark.createDataFrame([("k", i, t) for i, t in enumerate([200_000, 100_000, 1, 400_000, 5])], "key string, n long, tokens long")
    assert [r.batch for r in R.token_batches(items, "key", "n", "tokens").orderBy("n").collect()] == [0, 0, 1, 2, 3]
    many = spark.createDataFrame([("k", i, 1) for i in range(130)], "key string, n long, tokens long")
    assert {r.batch for r in R.token_batches(many, "key", "n", "tokens").collect()} == {0, 1, 2}
    jobs = spark.createDataFrame([(1, "pending", 5, 0, None, None), (2, "pending", 4, 8, None, None), (3, "leased", 3, 1, None, 0), (4, "pending", 1, 0, 10**12, None), (5, "done", 0, 0, None, None)], "id long, status string, created_at long, attempts int, not_before long, locked_at long")
    assert [r.id for r in R.lease(jobs, 10**9, 10).collect()] == [3, 1]
    parts = R.distribute(spark.createDataFrame([("k", i, w) for i, w in enumerate((1, 1, 1))], "key string, n long, w long"), "key", "n", "w", 100)
    assert [r.part for r in parts.orderBy("n").collect()] == [33, 33, 34]


def test_usage_scopes(spark):
    e = spark.createDataFrame([("a", 1, "request", 5), ("a", 2, "request", 7), ("a", 3, "session_cumulative", 99), ("b", 1, "turn", 3), ("b", 2, "turn", None)], "k string, i long, scope string, v long")
    assert {(r.k, r.scope, r.v) for r in X.normalize_usage(e, "k", "i", ["v"]).collect()} == {("a", "request", 12), ("b", "turn", None)}


def test_item_classes(spark):
    rows = [(0, "system", "text", "s", None, None), (1, "user", "text", "hi", True, True), (2, "assistant", "text", "a", None, True), (3, "assistant", "tool_call", "{}", None, None), (4, "assistant", "text", "b", None, None), (5, "user", "text", "auto", False, True), (6, "user", "text", "?", None, True)]
    items = spark.createDataFrame([("k", *r) for r in rows], "k string, n long, role string, kind string, text string, human boolean, visible boolean")
    got = [(r.category, r.layer, r.reason) for r in X.classify_items(items, "k", "n", "separate").orderBy("n").collect()]
    assert got == [
        ("instructions", "instructions", "structural_instruction"), ("human_input", "main", "human_structural_evidence"), ("assistant_other", "main", "visible_assistant_text"), ("tool_call", "main", "canonical_kind"),
        ("assistant_final", "review", "ambiguous_final_or_visibility"), ("instructions", "instructions", "structural_instruction"), ("human_input", "review", "legacy_ambiguous_authorship"),
    ]


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "x\x00y")], "k long, v string")
    assert X.export_table(df, str(tmp_path / "t"), ["k"]) == X.export_table(df, str(tmp_path / "u"), ["k"])


def test_imputation_equals_a_loop(spark):
    rows = [(i, 1 + i % 5, 100 * (i % 7), None if i % 3 == 0 else 1000 * (i + 1), 50 * (i % 2), f"v{i % 2}/m{i % 4}") for i in range(60)]
    got = {r.dialogue_id: r for r in I.impute_waits(spark.createDataFrame(rows, "dialogue_id long, calls long, output long, wait_ms long, api_ms long, model string")).collect()}
    donors = [r for r in rows if r[3]]
    feature = lambda r: (math.log1p(max(1, r[1])) * 0.35, math.log1p(r[2] / max(1, r[1])) * 0.65)
    for t in (r for r in rows if not r[3]):
        same, vendor = [d for d in donors if d[5] == t[5]], [d for d in donors if d[5][:2] == t[5][:2]]
        pool, source = (same, "same_model") if len(same) >= 8 else (vendor, "same_vendor") if len(vendor) >= 30 else (donors, "global")
        near = sorted((math.dist(feature(t), feature(d)), d[0], d) for d in pool)[:15]
        w = [1 / (0.15 + x) ** 2 for x, _, _ in near]
        each = math.exp(sum(a * math.log(max(1, d[3]) / max(1, d[1])) for a, (_, _, d) in zip(w, near, strict=True)) / sum(w))
        assert got[t[0]].source == source and abs(got[t[0]].ms - max(t[4], each * max(1, t[1]))) < 0.01


def test_nearest_donors_are_taken_from_lines(spark):
    """With ties on both sides of a target, few rows a line are compared, and they hold the nearest of all."""
    donors = [(i, "p", (i % 3) * 0.2, (i % 11) * 0.1) for i in range(240)]
    targets = [(1000 + i, "p", 0.2, i * 0.15) for i in range(7)]
    spark.createDataFrame([(*r, 1.0) for r in donors], "donor long, pool string, f1 double, f2 double, per_call double").createOrReplaceTempView("offers_")
    offers = spark.sql("select *, row_number() over (partition by pool, f1 order by f2, donor desc) as below, row_number() over (partition by pool, f1 order by f2, donor) as above from offers_")
    asked = spark.createDataFrame(targets, "dialogue_id long, pool string, t1 double, t2 double").join(offers.select("f1").distinct())
    found = I._beside(asked, offers)
    for t in targets:
        want = sorted((math.dist(t[2:], r[2:]), r[0]) for r in donors)[: I.NEIGHBOURS]
        assert sorted(r.donor for r in found.filter(f"dialogue_id = {t[0]}").select("donor").collect()) == sorted(x for _, x in want)


def test_lineage(spark):
    c = spark.createDataFrame([("c", "p", i, k) for i, k in enumerate("abcdx", 1)], "child string, parent string, i long, key string")
    p = spark.createDataFrame([("p", j, k) for j, k in enumerate("zabcd", 1)], "parent string, j long, key string")
    assert [tuple(r) for r in L.shared_prefixes(c, p).collect()] == [("c", 4, 2)]
    # Along the parent's a b q b: a copy is marked without moving on, and the first own request ends the walk.
    cases = {"c": ("aaxbab", [True, True, False, False, False, False]), "d": ("aabqq", [True, True, True, True, True]), "e": ("qbb", [True, True, False]), "f": ("za", [False, False])}
    m = spark.createDataFrame([(c, i, k) for c, (keys, _) in cases.items() for i, k in enumerate(keys)], "child string, sequence long, key string")
    r = spark.createDataFrame([(c, n, k) for c in cases for n, k in enumerate("abqb")], "child string, n long, key string")
    got = L.map_replays(m, r).orderBy("child", "sequence").collect()
    assert {c: [x.replayed for x in got if x.child == c] for c in cases} == {c: want for c, (_, want) in cases.items()}


def test_segments(spark):
    assert G.segment("") == [""] and G.segment("short") == ["short"]
    text = "\n\n".join(f"# H{i}\n\n" + "word " * 2000 for i in range(8))
    parts = G.segment(text)
    assert len(parts) > 1 and all(G.estimate(p) <= G.MOST for p in parts) and all(p.startswith("# H") for p in parts)
    fence = "```py\n" + "\n".join("x = 1" for _ in range(9000)) + "\n```"
    assert all(p.startswith("```py\n") and p.endswith("\n```") and G.estimate(p) <= G.MOST for p in G.segment(fence))
    many = "\n\n".join("para" for _ in range(9000))
    assert all(G.estimate(p) <= G.MOST for p in G.segment(many)) and "\n\n".join(G.segment(many)) == many
    assert [k for k, _ in G.blocks("# h\ntext\n\n```\na\n\nb\n```\nend\n```open")] == ["heading", "text", "fence", "text", "fence"]
    got = G.segment_documents(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [r.content for r in got if r.doc_id == 1] == parts and [r.segment_no for r in got if r.doc_id == 2] == [0]


def test_head_hash_is_that_of_the_reference(spark):
    texts = ["", "é" * 10, "a" * 5000, "a" * 4999 + "b", "a" * 65_536 + "b", "a" * 65_536 + "c", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, html string").select("i", T.head_hash(F.octet_length("html"), F.col("html")).alias("h"))
    plain = lambda b: hashlib.sha256(f"{len(b)}:".encode() + b[: 64 * 1024]).hexdigest()
    got = {r.i: r.h for r in rows.collect()}
    assert got == {i: None if t is None else plain(t.encode()) for i, t in enumerate(texts)} and got[2] != got[3] and got[4] == got[5]
