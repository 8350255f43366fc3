"""Search interface, extractors, maintenance and projections on hand-made rows."""

import hashlib
import hmac
import json

import numpy as np
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.functions import documents as D
from parley.operators import extractors as E
from parley.operators import maintenance as M
from parley.operators import projections as P
from parley.operators import retrieval as R
from parley.operators import searching as G

TEXTS = ["alpha beta", "alpha gamma alpha", "beta gamma", "delta", "alpha beta gamma", "alpha beta delta"]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    context = docs.select(
        "doc_id", (F.col("doc_id") % 5).alias("message_id"), F.lit("d").alias("dialogue_id"), F.when(F.col("doc_id") < 3, "codex").otherwise("omp").alias("harness"), F.lit("h").alias("host_label"), F.lit("n").alias("hostname"),
        F.lit("u").alias("user"), F.lit("w").alias("workspace"), F.lit(None).cast("string").alias("vendor"), F.lit("openai").alias("dialogue_vendor"), F.lit("m").alias("model"), F.lit("raw").alias("raw_model"), F.array(F.lit("a")).alias("model_aliases"),
        F.lit("high").alias("effort"), F.lit("user").alias("role"), F.lit("user_prompt").alias("document_type"), F.lit(None).cast("timestamp").alias("message_ts"), F.lit(datetime(2026, 1, 1)).alias("updated_at"), F.lit("active").alias("presence"),
    )
    return R.postings(docs, "doc_id", "text"), context


def test_search_modes_and_filters(spark, corpus):
    index, context = corpus
    run = lambda **k: [r.doc_id for r in G.search(index, 6, 2.2, context, **k).collect()]
    assert len(run(query="alpha")) == 3  # one dialogue gives three hits at most
    assert set(run(query="alpha beta", filters=G.SearchFilters(harness="omp"))) == {4, 5}
    assert run(query="alpha", filters=G.SearchFilters(vendor="openai", model="a", host="n", since=datetime(2026, 1, 1), until=datetime(2026, 1, 1)))
    assert run(query="alpha", filters=G.SearchFilters(deleted_only=True)) == [] and run(query="absent") == []
    vectors = spark.createDataFrame([(i, [float(i == 3), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    assert run(query="alpha", mode="vector", vectors=vectors, query_vector=[1.0, 0.0])[0] == 3
    assert run(query="delta", mode="hybrid", vectors=vectors, query_vector=[1.0, 0.0])[0] == 3
    assert run(query="alpha", mode="hybrid") == run(query="alpha")
    with pytest.raises(ValueError):
        run(query="x", mode="vector")
    with pytest.raises(ValueError):
        G.reject_forensic(raw=True)
    assert (G.candidates(1), G.candidates(100), G.candidates(9999)) == (50, 300, 1000) and not G.SearchFilters().any()


def test_snippets(spark):
    text = "word " * 100 + "Needle here. " + "tail " * 100
    got = spark.range(1).select(G.snippet(F.lit(text), ["needle", "c++"]).alias("s")).first().s
    assert "<em>Needle</em>" in got and got.startswith("…word") and got.endswith("…") and len(got) < 430
    assert spark.range(1).select(G.snippet(F.lit("short"), [])).first()[0] == "short"


def test_search_documents_follow_their_source(spark):
    def rows(h):
        return [(h, "d", 0, "system", None, True, "s"), (h, "d", 1, "user", True, True, "ask"), (h, "d", 2, "assistant", False, True, "one"), (h, "d", 3, "assistant", False, None, "two"), (h, "d", 4, "user", False, True, "auto"), (h, "d", 5, "assistant", False, True, "three")]

    m = spark.createDataFrame([r for h in E.RULES for r in rows(h)], "harness string, dialogue_id string, sequence long, role string, human_authored boolean, visible boolean, text string")
    got = {(r.harness, r.document_type): r.content for r in E.search_documents(m).collect()}
    assert {got[h, "user_prompt"] for h in E.RULES} == {"ask"}
    assert got["codex", "assistant_final"] == "three" and got["omp", "assistant_final"] == "one\nthree" and got["cursor", "assistant_final"] == "one\ntwo\nthree"
    ids = [r.document_id for r in E.prepared_documents(m).collect()]
    assert len(ids) == len(set(ids)) == 16


def test_json_functions(spark):
    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert x(D.usage_from_json(F.lit('{"promptTokenCount": 5, "cacheRead": "2"}'))).asDict() == {"input_tokens": 5, "cached_tokens": 2, "output_tokens": None, "reasoning_tokens": None}
    assert x(D.json_pointer(F.lit('{"a": [{"b c": 7}]}'), "/a/0/b c")) == "7" and x(D.json_pointer(F.lit("{}"), "/a")) is None
    assert x(D.skill_name(F.lit('{"skill": "pdf"}'))) == "pdf" and x(D.skill_name(F.lit(json.dumps(json.dumps({"skill": "pdf"}))))) == "pdf" and x(D.skill_name(F.lit("cat /x/web-art/SKILL.md"))) == "web-art" and x(D.skill_name(F.lit("none"))) is None
    assert x(D.canonical_json(F.lit('{"b": {"d": 1, "c": "é"}, "a": []}'))) == '{"a":[],"b":{"c":"é","d":1}}' and x(D.canonical_json(F.lit("{"))) is None
    assert x(D.alias(F.lit("me"), "key")) == "a_" + hmac.new(b"key", b"me", hashlib.sha256).hexdigest()[:16]
    assert tuple(x(D.host_class(F.lit("/Users/kim/x")))) == ("macos", "kim") and tuple(x(D.host_class(F.lit("/root/x")))) == ("linux-root", "root") and tuple(x(D.host_class(F.lit("x")))) == ("unknown", None)


def test_maintenance(spark):
    f = spark.createDataFrame
    seen = f([(1, "h", "/a", "r1"), (2, "h", "/b", None), (3, "h", "/c", None), (4, "h", "/b", "r1")], "id int, host string, path string, repository string")
    known = f([(10, "h", "/z", "r1"), (11, "h", "/b", None)], "workspace_id int, host string, path string, repository string")
    assert sorted(tuple(r) for r in M.resolve_workspaces(seen, known).collect()) == [(1, 10, "repository"), (2, 11, "path"), (3, None, "new"), (4, 10, "relinked")]
    e = "k string, first_failed int, last_failed int, n int"
    assert sorted(map(tuple, M.merge_errors(f([(None, 1, 2, 1)], e), f([(None, 5, 6, 1), ("a", 3, 3, 1)], e), ["k"]).collect()), key=str) == [("a", 3, 3, 1), (None, 1, 6, 2)]
    errors = f([("r", 1, False), ("r", 5, False), ("q", 1, False)], "revision_id string, run int, resolved boolean")
    assert sorted(map(tuple, M.resolve_errors(errors, f([("r", "parsed"), ("q", "partial")], "revision_id string, status string"), 5).collect())) == [("q", 1, False), ("r", 1, True), ("r", 5, False)]
    again, missing = M.select_reparse(f([(1,), (2,)], "id int"), f([(2,), (3,)], "id int"), "id")
    assert [r.id for r in again.collect()] == [2] and [r.id for r in missing.collect()] == [3]
    assert sorted(map(tuple, M.attribute_orphans(f([("1",), ("2",), ("3",)], "sha256 string"), f([("1", "x"), ("2", "x"), ("2", "y")], "sha256 string, location string")).collect())) == [("1", "repairable", "x"), ("2", "manual", None), ("3", "manual", None)]
    docs = f([(1, "size"), (2, "size"), (3, None), (4, None), (5, None)], "doc_id int, reason string")
    plan = M.privacy_plan(docs, f([(1, "completed"), (2, "pending"), (3, "cancelled"), (4, "completed")], "doc_id int, status string"), f([(1,), (4,)], "doc_id int"))
    assert [r.action for r in plan.orderBy("doc_id").collect()] == ["drop_vector", "cancel_job", "enqueue", "keep", "enqueue"]
    audit = M.vector_audit(f([(1, [1.0]), (2, [1.0, 2.0])], "doc_id int, vector array<double>"), f([(1, "completed"), (3, "completed")], "doc_id int, status string"), 2)
    assert {r.problem: r.n for r in audit.collect()} == {"wrong_dimension": 1, "vector_without_completed_job": 1, "completed_job_without_vector": 1}
    assert [r.id for r in M.latest_attempts(f([("a", 1, 1), ("a", 2, 2)], "lineage_key string, attempt int, id int")).collect()] == [2]
    doc = M.thread_json(f([("t", 2, "b"), ("t", 1, "a")], "t string, n int, text string"), "t", "n", ["text"]).first().document
    assert json.loads(doc) == {"t": "t", "messages": [{"text": "a"}, {"text": "b"}]}
    turns = f([("s", 0, "started"), ("s", 5, "complete"), ("s", 9, "started"), ("s", 12, "started"), ("s", 20, "other")], "session string, ms long, kind string")
    assert [tuple(r)[2:] for r in M.open_turns(turns).orderBy("turn").collect()] == [(5, "complete"), (0, "incomplete"), (8, "incomplete")]
    times = M.mapped_session_time(f([("m", "h", 5), ("x", "h", 7)], "model string, harness string, active_ms long"), f([("m", "h"), ("m", "g")], "model string, harness string"))
    assert sorted(map(tuple, times.collect())) == [("m", "g", 0, 0), ("m", "h", 5, 1)]


def test_projections(spark):
    v = spark.createDataFrame([(i, [float(i % 2), float(1 - i % 2), 0.01 * i]) for i in range(1, 21)], "vec_id long, embedding array<float>")
    groups = {}
    for r in P.spherical_kmeans(v, 2).collect():
        groups.setdefault(r.cluster, set()).add(r.vec_id % 2)
    assert sorted(groups.values(), key=str) == [{0}, {1}]
    assert all(len(r.p) == 5 for r in v.select(P.random_projection(F.col("embedding"), 3, 5).alias("p")).collect())
    got, axes = P.principal_axes(v, 2)
    x = np.array([r.embedding for r in v.orderBy("vec_id").collect()], float)
    x -= x.mean(axis=0)
    want = np.linalg.svd(x)[2][:2].T
    assert np.allclose(np.linalg.svd(want.T @ axes)[1], 1, atol=1e-6)  # the same plane
    mine = np.array([r.axes for r in got.orderBy("vec_id").collect()])
    assert np.allclose(mine.var(axis=0), np.linalg.svd(x)[1][:2] ** 2 / len(x), rtol=1e-6)
    assert P.projection_error(spark.createDataFrame([(1.0, 1.0), (2.0, 2.5)], "a double, b double"), "a", "b").first().mae == 0.25
    mock = spark.range(1).select(P.mock_vector(F.lit("x"), 10).alias("a"), P.mock_vector(F.lit("x"), 10).alias("b")).first()
    assert mock.a == mock.b and len(mock.a) == 10 and all(-1 <= x < 1 for x in mock.a)
