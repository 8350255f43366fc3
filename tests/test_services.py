"""Scans, presence, syncs, record streams, stored indexes, the export, preflight and evaluation on small cases."""

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.operators import ann as A
from parley.operators import commits as C
from parley.operators import evaluation as E
from parley.operators import inverted as V
from parley.operators import items as I
from parley.operators import retrieval as R
from parley.operators import star_export as X
from parley.operators.storage import Work, setting
from parley.sources import scans as N
from parley.sources.records import RecordStream, StreamError, as_records
from parley.streaming import presence as P
from parley.streaming.ingest import sync

# ------------------------------------------------------------------ scans


def test_scan_lists_files_and_says_what_is_missing(spark, tmp_path):
    for name in ("a.jsonl", "._a.jsonl", "deep/er/b.jsonl", "deep/c.txt"):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text("x" * len(name))
    (tmp_path / "root" / "link").symlink_to(tmp_path / "root" / "deep")
    (tmp_path / "one.jsonl").write_text("xy")
    (tmp_path / "empty").mkdir()
    roots = [str(tmp_path / x) for x in ("root", "one.jsonl", "empty", "gone")]
    status, files = N.scan_roots(spark, [*roots[:3], f"file://{roots[3]}"])
    got = {os.path.basename(r.root): (r.status, r.n_files, r.n_errors) for r in status.collect()}
    assert got == {"root": ("complete", 3, 0), "one.jsonl": ("complete", 1, 0), "empty": ("complete", 0, 0), "gone": ("unavailable", 0, 1)}
    assert {(os.path.basename(r.root), r.relative_path, r.size_bytes) for r in files.collect()} == {("root", "a.jsonl", 7), ("root", "deep/er/b.jsonl", 15), ("root", "deep/c.txt", 10), ("one.jsonl", "one.jsonl", 2)}
    assert {r[1] for r in N.remote_rows(spark, f"file://{roots[0]}")} >= {"a.jsonl", "deep/er/b.jsonl", "deep/c.txt"}
    assert list(N.remote_rows(spark, f"file://{roots[3]}"))[0][4:] == ("unavailable", True)


def test_unreadable_folders_make_a_scan_partial(tmp_path):
    (tmp_path / "shut").mkdir()
    (tmp_path / "open.txt").write_text("x")

    def list_(folder):
        if folder.endswith("shut"):
            raise PermissionError(13, "no")
        return N.entries(folder)

    rows = list(N.walk(str(tmp_path), list_=list_))
    assert [(r[1], r[4], r[5]) for r in rows] == [("open.txt", None, False), ("shut", "permission_denied", False)]
    rows = list(N.walk(str(tmp_path / "shut"), list_=list_))
    assert rows[0][4:] == ("permission_denied", True)
    assert N.status_of(OSError(5, "io")) == "failed"


def plain_presence(scans, confirmations):
    state, out = {}, set()
    for scan, complete, seen in scans:
        for path, f in seen.items():
            was = state.get(path)
            action = "new" if not was else "returned" if was[0] != "active" else "unchanged" if was[2] == f else "changed"
            state[path] = ("active", 0, f)
            out.add((scan, path, action, "active", 0))
        for path, (_, missed, f) in list(state.items()):
            if path not in seen and complete:
                state[path] = ("deleted" if missed + 1 >= confirmations else "missing", missed + 1, f)
                out.add((scan, path, "missing", *state[path][:2]))
    return out, state


def test_presence_over_a_stream_equals_a_loop(spark, tmp_path):
    rng, base = random.Random(2), str(tmp_path)
    scans = [(n, rng.random() < 0.7, {f"p{i}": str(rng.randint(0, 1)) for i in range(40) if rng.random() < 0.6}) for n in range(1, 7)]
    kind = "root string, scan bigint, complete boolean, path string, fingerprint string"
    for part in (scans[:2], scans[2:3], scans[1:5], scans[5:]):  # scans 2 and 3 arrive twice
        rows = [("r", n, c, p, f) for n, c, seen in part for p, f in [*seen.items(), (None, None)]]
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{base}/scans")
        for _ in range(2):
            P.run_presence(spark, f"{base}/scans", f"{base}/moves", f"{base}/state", 2)
    moves = spark.read.parquet(f"{base}/moves")
    want, state = plain_presence(scans, 2)
    assert sorted((r.scan, r.path, r.action, r.presence, r.missed) for r in moves.collect()) == sorted(want)
    assert {r.path: (r.presence, r.missed, r.fingerprint) for r in P.present(moves).collect()} == state


def test_sync_commits_each_arrival_once(spark, tmp_path):
    src, state = f"{tmp_path}/src", f"{tmp_path}/state"
    t = C.CommitTable(spark, f"file://{tmp_path}/t", ["id"], 4)
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 2)], "id long, v string, at int").write.parquet(src)
    assert [sync(spark, src, "id long, v string, at int", t, state, ["at"]) for _ in range(2)] == [1, 1]
    spark.createDataFrame([(1, "z", 3), (3, "d", 1)], "id long, v string, at int").write.mode("append").parquet(src)
    assert [sync(spark, src, "id long, v string, at int", t, state, ["at"]) for _ in range(2)] == [2, 2]
    assert {(r.id, r.v) for r in t.read().collect()} == {(1, "z"), (2, "c"), (3, "d")}


# ------------------------------------------------------------------ records


def test_record_stream_splits_and_prunes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é\n\"x\"", None), (2, None, 2.5)], "id_no bigint, t string, x double")
    as_records(rows, "a", ["id_no"]).unionByName(as_records(spark.range(3).select(F.col("id").alias("k")), "b", ["k"])).write.text(f"{tmp_path}/s")
    s = RecordStream(spark, f"{tmp_path}/s", {"a": {"id_no": "bigint", "t": "string", "x": "double"}, "b": {"k": "bigint"}})
    assert sorted(map(tuple, s.table("a").collect())) == [(1, "é\n\"x\"", None), (2, None, 2.5)] and s.counts == {"a": 2, "b": 3}
    plan = s.table("b", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "table#" in plan and "PartitionFilters: [isnotnull(table" in plan


def test_record_stream_names_what_it_refuses(spark, tmp_path):
    bad = ['{"table":"a","id":"a:1","v":1}', "{broken", "[1]", '{"table":"zz","id":"zz:1"}', '{"table":"a","id":"b:1"}', '{"table":"a","id":"a:2","v":"' + "x" * 100 + '"}', "  "]
    (tmp_path / "s.txt").write_text("\n".join(bad))
    with pytest.raises(StreamError, match="5 records of no table"):
        RecordStream(spark, str(tmp_path / "s.txt"), {"a": {"v": "int"}}, 80)
    s = RecordStream(spark, str(tmp_path / "s.txt"), {"a": {"v": "int"}, "b": {"v": "int"}}, 80, strict=False)
    assert sorted(r.reason for r in s.errors().collect()) == ["identity_mismatch", "not_json", "not_json", "too_long", "unknown_table"]
    assert [r.v for r in s.table("a").collect()] == [1] and s.table("b").count() == 0
    (tmp_path / "t.txt").write_text(bad[0])
    with pytest.raises(StreamError, match=r"no records of \['b'\]"):
        RecordStream(spark, str(tmp_path / "t.txt"), {"a": {"v": "int"}, "b": {"v": "int"}})


# ------------------------------------------------------------------ indexes


def test_cells_hold_every_vector_and_find_what_is_near(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(m % 7, 0.6) for m in range(i % 5, i % 5 + 12)], i % 2) for i in range(900)] + [(900, None, 0), (901, [0.0] * 12, 0), (902, [1.0] * 12, 1), (902, [1.0] * 12, 1)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    A.build_index(v, f"{tmp_path}/ix", cells=24)
    assert spark.read.parquet(f"{tmp_path}/ix/vectors").count() == 902
    q = v.filter("vec_id % 100 = 0 and vec_id < 900").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    some = v.filter("vec_id not in (900, 901)")
    for where, ef in ((None, 200), (F.col("label") == 1, 60)):
        exact = R.cosine_search(some if where is None else some.filter(where), q, 20)
        got = A.recall(A.search(spark, f"{tmp_path}/ix", q, 20, where, ef), exact).agg(F.sum("found"), F.sum("wanted")).first()
        assert got[0] >= 0.95 * got[1] and got[1] == 180
    assert A.search(spark, f"{tmp_path}/ix", q, 20, ef=10**6).count() == 180
    A.build_index(v.limit(0), f"{tmp_path}/none")
    assert A.search(spark, f"{tmp_path}/none", q, 5).count() == 0


def test_inverted_index_equals_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 5)
    rng = random.Random(4)
    names = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    docs = [(i, " ".join(names[min(int(rng.expovariate(0.3)), 24)] for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(300, None), (301, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "ba be"), (2, "gu go bi"), (3, "nowhere"), (4, ""), (5, "gu")], "query_id bigint, text string")
    V.build_inverted(d, f"{tmp_path}/ix")
    index = V.Inverted(spark, f"{tmp_path}/ix")
    from parley.functions.texts import analyze

    some = d.withColumn("text", F.coalesce("text", F.lit("")))
    n, avg = some.agg(F.count(F.lit(1)), F.avg(F.size(analyze(F.col("text"))))).first()
    postings = R.postings(some, "doc_id", "text")
    for match_all in (True, False):
        want = {(r.query_id, r.doc_id): r.score for r in R.bm25(postings, n, avg, q, match_all).collect()}
        got = {(r.query_id, r.doc_id): r.score for r in index.bm25(q, match_all).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got) and want
    for k in (1, 3, 10):
        want = [(r.query_id, r["rank"], r.score) for r in R.top_k(R.bm25(postings, n, avg, q, False), k, ["query_id"]).collect()]
        got = [(r.query_id, r["rank"], r.score) for r in index.top(q, k).collect()]
        assert [(a, b, round(c, 4)) for a, b, c in sorted(got)] == [(a, b, round(c, 4)) for a, b, c in sorted(want)]


# ------------------------------------------------------------------ items and the export

_MESSAGES = "revision_id string, message_id string, sequence bigint, harness string, role string, raw_role string, human boolean, visible boolean, is_meta boolean, origin_kind string, typed_text string, side boolean, phase string, finish string, turn_result boolean, usage string"
_CHUNKS = "message_id string, chunk_id string, chunk_sequence bigint, kind string, content string, auto_context boolean, tool_call_id string, tool_name string, raw_kind string, source_locator string"


def message(rev, n, role, harness="codex", **more):
    row = {"revision_id": rev, "message_id": f"{rev}{n}", "sequence": n, "harness": harness, "role": role}
    return [{**row, **more}.get(f.split()[0]) for f in _MESSAGES.split(", ")]


def chunk(message_id, n, content, kind="text", **more):
    row = {"message_id": message_id, "chunk_id": f"{message_id}/{n}", "chunk_sequence": n, "kind": kind, "content": content, "source_locator": f"line:{n}"}
    return [{**row, **more}.get(f.split()[0]) for f in _CHUNKS.split(", ")]


MESSAGES = [
    message("r", 0, "system"), message("r", 1, "user", typed_text="do it", human=True), message("r", 2, "assistant", visible=True, usage='{"inputTokens":3,"secret":"x","outputTokens":1.5}'),
    message("r", 3, "assistant", visible=True, phase="final_answer"), message("r", 4, "user", human=None), message("r", 5, "assistant", visible=None), message("r", 6, "user", is_meta=True), message("r", 7, "assistant", visible=True),
    message("s", 1, "user", "opencode", human=True), message("s", 2, "assistant", "opencode", visible=True, finish="stop"), message("s", 3, "assistant", "opencode", visible=True),
]
CHUNKS = [
    chunk("r0", 0, "be good"), chunk("r1", 0, "<ctx>do it</ctx>"), chunk("r2", 0, "working"), chunk("r2", 1, "{}", "tool_call", tool_call_id="c1", tool_name="sh"), chunk("r2", 2, "ok", "tool_result", tool_call_id="c1"),
    chunk("r2", 3, "{}", "tool_call", tool_call_id="c2"), chunk("r3", 0, "done"), chunk("r4", 0, "again"), chunk("r5", 0, "vague"), chunk("r5", 1, "shape", "object"), chunk("r6", 0, "caveat"), chunk("r7", 0, "late"),
    chunk("s1", 0, "go"), chunk("s2", 0, "one"), chunk("s2", 1, "two"), chunk("s3", 0, "three"),
]


def test_items_have_reasons(spark):
    m, c = spark.createDataFrame(MESSAGES, _MESSAGES), spark.createDataFrame(CHUNKS, _CHUNKS)
    items = {(r.item_id, r.reason): r for r in I.project_items(m, c, "metadata").collect()}
    assert {k: (r.layer, r.content) for k, r in items.items()} == {
        ("r0:instructions:0", "structural_instruction"): ("instructions", "be good"), ("r1:human_input:0", "human_structural_evidence"): ("main", "do it"),
        ("r1:instructions:0", "codex_confirmed_input_remainder"): ("instructions", "<ctx></ctx>"), ("r2:assistant_other:0", "visible_assistant_text"): ("main", "working"), ("r2:tool_call:1", "canonical_kind"): ("main", "{}"),
        ("r2:tool_result:2", "canonical_kind"): ("main", "ok"), ("r2:tool_call:3", "canonical_kind"): ("main", "{}"), ("r2:usage:derived", "normalized_usage_allowlist"): ("main", '{"inputTokens":3}'),
        ("r3:assistant_final:0", "harness_final_evidence"): ("main", "done"), ("r4:human_input:0", "legacy_ambiguous_authorship"): ("metadata", None), ("r5:object:1", "unclassified_canonical_kind"): ("metadata", None),
        ("r5:assistant_other:0", "legacy_ambiguous_visibility"): ("metadata", None), ("r6:instructions:0", "structural_instruction"): ("instructions", "caveat"), ("r7:assistant_other:0", "visible_assistant_text_fallback"): ("main", "late"),
        ("s1:human_input:0", "human_structural_evidence"): ("main", "go"), ("s2:assistant_final:0", "harness_final_evidence"): ("main", "one\ntwo\nthree"),
    }
    turns = {r.item_id: r.turn_id for r in items.values()}
    assert turns["r3:assistant_final:0"] == "r:turn:r1" and turns["r7:assistant_other:0"] == "r:turn:r4" and turns["r0:instructions:0"] == "r:turn:r0"
    assert items["s2:assistant_final:0", "harness_final_evidence"].source_chunks == ["s2/0", "s2/1", "s3/0"]


def test_items_move_rows_once_where_chunks_name_their_revision(spark):
    m, c = spark.createDataFrame(MESSAGES, _MESSAGES), spark.createDataFrame(CHUNKS, _CHUNKS)
    named = c.withColumn("revision_id", F.substring("message_id", 1, 1))
    got = [sorted((r.item_id, r.reason, str(r.content), r.turn_id, r.source_chunks) for r in I.project_items(m, x, "separate").collect()) for x in (c, named)]
    assert got[0] == got[1] and len(got[0]) == 16
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = I.in_turns(m, named)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # messages and chunks, by the revision; joins and windows add none
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_blank_texts_and_hidden_figures(spark):
    m = [message("b", 1, "user", human=True), message("b", 2, "assistant", visible=True, phase="final_answer", usage='{"output\\u0054okens":7,"inputTokens":"x"}'), message("b", 3, "assistant", visible=True), message("b", 4, "system", usage='{"totalTokensReported":-2}')]
    c = [chunk("b1", 0, "go"), chunk("b2", 0, "  "), chunk("b3", 0, " "), chunk("b3", 1, "")]
    rows = {r.item_id: (r.reason, r.content) for r in I.project_items(spark.createDataFrame(m, _MESSAGES), spark.createDataFrame(c, _CHUNKS)).collect()}
    # One blank chunk isn't an answer, nor is the last message, whose other chunk is empty; figures may have escaped names.
    assert rows == {
        "b1:human_input:0": ("human_structural_evidence", "go"), "b2:assistant_other:0": ("visible_assistant_text", "  "), "b3:assistant_other:0": ("visible_assistant_text", " "), "b3:assistant_other:1": ("visible_assistant_text", ""),
        "b2:usage:derived": ("normalized_usage_allowlist", '{"outputTokens":7}'), "b4:usage:derived": ("normalized_usage_allowlist", '{"totalTokensReported":-2}'),
    }


def test_export_is_whole_and_checked(spark, tmp_path, monkeypatch):
    extra = {"timestamp": F.lit("2026-01-01"), "vendor": F.lit("v"), "model": F.when(F.col("role") == "assistant", "m"), "service_provider": F.lit(None).cast("string"), "reasoning_effort": F.lit(None).cast("string"), "response_status": F.lit(None).cast("string")}
    m, c = spark.createDataFrame(MESSAGES, _MESSAGES).withColumns(extra), spark.createDataFrame(CHUNKS, _CHUNKS)
    names = "revision_id string, dialogue_id string, source_revision string, canonical_hash string, message_count bigint, chunk_count bigint, is_current boolean, harness string, installation string, host string, host_label string, platform string, arch string, workspace string, title string, parser_name string, parser_version string, source_dialogue string, parent_dialogue string"
    rows = [("r", "dr", None, "h", 8, 12, True, "codex", "i", "host", None, "linux", None, None, "T", "p", "1", "src-r", None), ("s", "ds", None, "h", 3, 4, True, "opencode", "i", "host", None, "linux", None, None, None, "p", "1", "src-s", "src-r"), ("t", "dt", None, "h", 0, 0, False, "omp", "i", "h2", None, None, None, None, None, "p", "1", None, "x")]
    manifest = spark.createDataFrame(rows, names)
    counts = X.export(manifest, m, c, f"{tmp_path}/out", "separate")
    assert set(counts) == set(X.RELATIONS) and counts["corpus_manifest"] == 3 and counts["dialogues"] == 2 and counts["items"] == 16 and counts["item_sources"] == 17
    opened = X.open_export(spark, f"{tmp_path}/out", "t_")
    rel = {(r.kind, r.status): r.to_item or r.to_revision for r in spark.table(opened["relations"]).collect()}
    assert set(rel) == {("tool_call_result", "confirmed"), ("tool_call_result", "unpaired"), ("parent", "confirmed")} and rel["parent", "confirmed"]
    assert sorted(r.id for r in spark.table(opened["relations"]).collect()) == [0, 1, 2]
    qa = {r.content: r.attribution_status for r in spark.table(opened["v_qa"]).collect()}
    assert qa == {"do it": "single_source", "done": "single_source", "go": "single_source", "one\ntwo\nthree": "multiple_sources_see_item_sources"}
    raw = [x.value for x in spark.read.text(f"{tmp_path}/out/*/*.parquet").limit(1).collect()]
    assert raw is not None and not spark.table(opened["items"]).filter("id like 'r%'").count()
    plan = spark.sql(f"select count(*) from {opened['analysis_items']} a join {opened['items']} i on i.id = a.item_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # both sides are bucketed by the item
    info = {r.key: json.loads(r.value) for r in spark.table(opened["export_info"]).collect()}
    assert info["counts"]["manifest_chunks"] == 16 and info["payload_digests"]["analysis_items"]["rows"] == counts["analysis_items"]
    read = {name: spark.table(opened[name]) for name in X.RELATIONS if name != "export_info"}
    bad = read | {"items": read["items"].filter("category <> 'usage'"), "hosts": read["hosts"].unionByName(read["hosts"])}
    audited = X.audit(bad)
    found = {r.rule: r.violations for r in audited.collect()}
    assert {k: v for k, v in found.items() if v} == {"unique:hosts": counts["hosts"], "reference:analysis_items.item_id": 1} and len(found) == len(X.KEYS) + len(X.FOREIGN_KEYS)
    assert "LeftAnti" not in audited._jdf.queryExecution().executedPlan().toString()  # ids and references are moved once
    # Two exports don't share names of rows.
    X.export(manifest, m, c, f"{tmp_path}/two", "separate")
    ids = [{r.id for r in spark.read.parquet(f"{tmp_path}/{x}/messages").collect()} for x in ("out", "two")]
    assert not ids[0] & ids[1] and len(ids[0]) == len(ids[1])
    with pytest.raises(X.ExportError, match="counts"):
        X.export(manifest.withColumn("chunk_count", F.lit(5)), m, c, f"{tmp_path}/bad")
    with pytest.raises(X.ExportError, match="isn't a whole export"):
        X.open_export(spark, f"{tmp_path}/bad")
    monkeypatch.setattr(X, "_write", lambda rows, path, bucket, f=X._write: f(rows.fillna("", ["content"]) if path.endswith("review_items") or path.endswith("chunks") else rows, path, bucket))
    with pytest.raises(X.ExportError, match="texts that were read back"):
        X.export(manifest, m, c, f"{tmp_path}/changed", "separate")


def export_input(spark):
    extra = {"timestamp": F.lit("2026-01-01"), "vendor": F.lit("v"), "model": F.when(F.col("role") == "assistant", "m"), "service_provider": F.lit(None).cast("string"), "reasoning_effort": F.lit(None).cast("string"), "response_status": F.lit(None).cast("string")}
    m, c = spark.createDataFrame(MESSAGES, _MESSAGES).withColumns(extra), spark.createDataFrame(CHUNKS, _CHUNKS).withColumn("revision_id", F.substring("message_id", 1, 1))
    kind = "revision_id string, dialogue_id string, source_revision string, canonical_hash string, message_count bigint, chunk_count bigint, is_current boolean, harness string, installation string, host string, host_label string, platform string, arch string, workspace string, title string, parser_name string, parser_version string, source_dialogue string, parent_dialogue string"
    rows = [(r, f"d{r}", None, "h", n, k, True, h, "i", "host", None, "linux", None, None, None, "p", "1", f"src-{r}", None) for r, n, k, h in (("r", 8, 12, "codex"), ("s", 3, 4, "opencode"))]
    return spark.createDataFrame(rows, kind), m, c


def test_export_moves_rows_by_the_revision_alone_and_leaves_no_work_tables(spark, tmp_path, monkeypatch):
    manifest, m, c = export_input(spark)
    plans, written, shared = {}, Work.placed, Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "parley")
    monkeypatch.setattr(Work, "placed", lambda self, df, name, column: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or written(self, df, name, column))
    before, tables, read = {p.name for p in shared.glob("*")}, {t.name for t in spark.catalog.listTables()}, []
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        with Work(spark, 8) as work:  # dealt by the revision, as an export of so few rows deals them
            m, c = (work.placed(x.repartition(work.parts, "revision_id"), name, "revision_id") for name, x in (("m", m), ("c", c)))
            monkeypatch.setattr(X, "parts_of", lambda spark, rows: work.parts)
            counts = X.export(manifest, m, c, f"{tmp_path}/out", "separate", fixed=lambda: read.append(work.drop("m", "c")))
        moved = {name: plans[name].count("Exchange hashpartitioning") for name in ("chunks", "turned", "items", "kept", "sent")}
        with pytest.raises(X.ExportError, match="counts"):
            X.export(manifest.withColumn("chunk_count", F.lit(5)), *export_input(spark)[1:], f"{tmp_path}/bad")
    assert counts["items"] == 16 and read == [None]
    assert set(moved.values()) == {0}
    assert {p.name for p in shared.glob("*")} == before and {t.name for t in spark.catalog.listTables()} == tables
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_view_counts_sources_as_the_plain_join_does(spark, tmp_path):
    X.export(*export_input(spark), f"{tmp_path}/out", "separate")
    opened = X.open_export(spark, f"{tmp_path}/out", "c_")
    plain = spark.sql(f"select s.item_id, count(distinct c.message_id) as n from {opened['item_sources']} s join {opened['chunks']} c on c.id = s.chunk_id group by s.item_id")
    got = {tuple(r) for r in spark.table(opened["v_item_source_counts"]).collect()}
    assert got == {tuple(r) for r in plain.collect()} and sorted(n for _, n in got)[-2:] == [1, 2]
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = spark.table(opened["v_item_source_counts"])._jdf.queryExecution().executedPlan().toString()
    # Sources of more than one chunk go to their chunks, and what is counted comes back; chunks and single sources stay.
    assert plan.count("Exchange hashpartitioning(chunk_id") == 1 and "Exchange hashpartitioning(id" not in plan


def test_audit_packs_ids_without_mixing_them(spark):
    ids = ["ite_0123456789abcdef", "ite_0123456789abcdee", "mes_0123456789abcdef", "ite_0123456789ABCDEF", "ite_ABCDEFGH", "ite_4142434445464748", "", "\x00", "7", None]
    packed = [bytes(r[0]) if r[0] is not None else None for r in spark.createDataFrame([(i,) for i in ids], "id string").select(X._packed(F.col("id"))).collect()]
    assert len(set(packed)) == len(ids) and packed[-1] is None and len(packed[0]) == 12


# ------------------------------------------------------------------ evaluation


def test_drift_and_bad_judgments_stop_a_run(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "text 1", "en", "model"), (2, "text 2", "ru", "path")], "query_id bigint, text string, language string, query_type string")
    expected = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "query_id bigint, doc_id bigint, grade int")
    never = spark.createDataFrame([(1, "text 3"), (2, "nothing")], "query_id bigint, text string")
    ranked = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 4, 1)], "query_id bigint, doc_id bigint, rank bigint")
    way, bounds = {"way": lambda _: ranked}, {"least": 2, "most": 3}
    out = {r.query_id: (r.scenario, r.mrr, r.forbidden) for r in E.run_scenarios(lambda: docs, way, q, expected, never, E.corpus_digest(docs), **bounds).collect()}
    assert out == {1: ("way", 1.0, 1), 2: ("way", 0.0, 0)}
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    with pytest.raises(E.CorpusDrift, match="bound"):
        E.run_scenarios(lambda: changed, way, q, expected, never, E.corpus_digest(docs), **bounds)
    seen = iter([docs, docs, changed])
    with pytest.raises(E.CorpusDrift, match="during way"):
        E.run_scenarios(lambda: next(seen), way, q, expected, never, **bounds)
    with pytest.raises(E.JudgmentError, match="None: number_of_queries"):
        E.run_scenarios(lambda: docs, way, q, expected, never)
    with pytest.raises(E.JudgmentError, match="2: nothing_expected"):
        E.run_scenarios(lambda: docs, way, q, expected.filter("query_id = 1"), never, **bounds)
