"""Readers, transcript parsers and incremental ingest on hand-made files."""

import json

import pytest

from parley.sources.files import select_files
from parley.sources.jsonl import json_lines, read_lines, time_ms
from parley.sources.transcripts import PARSERS, parse_file, parse_transcripts
from parley.streaming.ingest import sessions

T0 = "2026-01-01T00:00:00Z"


def lines(*records):
    return "\n".join(json.dumps(r) for r in records)


CODEX = lines(
    {"timestamp": T0, "type": "session_meta", "payload": {"id": "S", "timestamp": T0}},
    {"timestamp": T0, "type": "turn_context", "payload": {"model": "m1"}},
    {"timestamp": T0, "type": "event_msg", "payload": {"type": "task_started", "turn_id": "t1"}},
    {"timestamp": T0, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
    {"timestamp": T0, "type": "event_msg", "payload": {"type": "user_message", "message": "do it"}},
    {"timestamp": T0, "type": "response_item", "payload": {"type": "function_call", "call_id": "c", "name": "sh", "arguments": "{}"}},
    {"timestamp": T0, "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "ok"}},
    {"timestamp": T0, "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}},
    *[{"timestamp": T0, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 2}}}}] * 2,
    {"timestamp": "2026-01-01T00:00:09Z", "type": "event_msg", "payload": {"type": "task_complete"}},
    {"timestamp": T0, "type": "brand_new", "payload": {}},
)


def test_codex_counts_once_and_confirms_users():
    rows = parse_file("f", "codex", CODEX + "\n{broken")
    users = [r for r in rows if r.get("role") == "user"]
    assert len(users) == 1 and users[0]["human_authored"] is True and users[0]["wait_ms"] == 9000
    answer = next(r for r in rows if r.get("text") == "done")
    assert answer["usage"]["input_tokens"] == 10 and answer["usage"]["total_tokens"] == 12 and answer["model"] == "m1"
    assert sum(r.get("role") == "unknown" for r in rows) == 1 and sum(bool(r.get("diagnostic")) for r in rows) == 2
    assert {r["dialogue_id"] for r in rows} == {"S"}


def test_codex_answers_repeated_much_later_are_one():
    answer = {"timestamp": T0, "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}}
    call = {"timestamp": T0, "type": "response_item", "payload": {"type": "function_call", "call_id": "c", "name": "sh", "arguments": "{}"}}
    said = lambda text: {"timestamp": T0, "type": "event_msg", "payload": {"type": "agent_message", "message": text}}
    rows = parse_file("f", "codex", lines(answer, *[call] * 9, said("done"), said("new"), *[call] * 9, said("new"), said(["odd"])))
    assert [r["text"] for r in rows if r.get("text")] == ["done", "new", '["odd"]']


@pytest.mark.parametrize("harness, path, mine", [("codex", "a/B.JSONL", True), ("codex", "a/._b.jsonl", False), ("kimi-code", "s/wire.jsonl", True), ("kimi-code", "s/x.jsonl", False), ("claude-desktop", "skills-plugin/a", False), ("claude-desktop", "x/rpm/a", False), ("claude-desktop", "MANIFEST-1", True)])
def test_files_of_a_format(spark, harness, path, mine):
    assert select_files(spark.createDataFrame([(path,), (None,)], "path string"), harness).count() == int(mine)


def test_streamed_lines_of_one_message_merge():
    part = lambda text: {"type": "assistant", "sessionId": "A", "timestamp": T0, "message": {"id": "api1", "model": "m", "content": [{"type": "text", "text": text}], "usage": {"input_tokens": 3, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 2, "output_tokens": 1}}}
    user = {"type": "user", "sessionId": "A", "timestamp": T0, "message": {"content": "q"}}
    tool = {"type": "user", "sessionId": "A", "timestamp": T0, "message": {"content": [{"type": "tool_result", "tool_use_id": "x", "content": "r"}]}}
    rows = parse_file("f", "claude-code", lines(user, part("a"), part("b"), tool))
    assert [r["role"] for r in rows] == ["user", "assistant", "tool"] and rows[1]["text"] == "a\nb"
    assert rows[1]["usage"]["input_tokens"] == 10 and rows[1]["usage"]["total_tokens"] == 11
    assert rows[0]["human_authored"] is None and rows[2]["human_authored"] is False and rows[2]["visible"] is False


SMALL = {
    "claude-desktop": lines({"type": "user", "session_id": "D", "_audit_timestamp": T0, "message": {"content": "q"}}, {"type": "assistant", "session_id": "D", "_audit_timestamp": T0, "message": {"model": "m", "content": [{"type": "text", "text": "a"}]}}, {"type": "result", "duration_ms": 70}),
    "qwen-code": lines({"type": "user", "sessionId": "D", "timestamp": T0, "message": {"parts": [{"text": "q"}]}}, {"type": "assistant", "sessionId": "D", "timestamp": T0, "model": "m", "message": {"parts": [{"text": "t", "thought": True}, {"text": "a"}]}, "usageMetadata": {"promptTokenCount": 4, "candidatesTokenCount": 1}}),
    "kimi-code": lines({"type": "metadata", "sessionId": "D", "time": 1}, {"type": "context.append_loop_event", "time": 4, "event": {"type": "step.end", "usage": {"inputOther": 1, "inputCacheRead": 2, "output": 1}}}, {"type": "context.append_loop_event", "time": 3, "event": {"type": "content.part", "text": "a"}}, {"type": "turn.prompt", "time": 1, "text": "q", "origin": "user"}, {"type": "context.append_loop_event", "time": 2, "event": {"type": "step.begin"}}),
    "omp": lines({"type": "session", "id": "D"}, {"type": "message", "timestamp": T0, "message": {"role": "user", "content": [{"type": "text", "text": "q"}]}}, {"type": "message", "timestamp": T0, "message": {"role": "assistant", "model": "m", "duration": 70, "content": [{"type": "text", "text": "a"}], "usage": {"input": 1, "cacheRead": 2, "cacheWrite": 3, "output": 4}}}),
    "opencode": lines({"table": "session", "id": "D"}, {"table": "message", "id": "2", "time_created": 2, "data": {"role": "assistant", "modelID": "m"}}, {"table": "message", "id": "1", "time_created": 1, "data": {"role": "user"}}, {"table": "part", "id": "p", "message_id": "1", "time_created": 1, "data": {"type": "text", "text": "q"}}, {"table": "part", "id": "r", "message_id": "2", "time_created": 2, "data": {"type": "text", "text": "a"}}),
    "cursor": lines({"key": "composerData:D", "value": {"fullConversationHeadersOnly": [{"bubbleId": "1"}, {"bubbleId": "2"}, {"bubbleId": "3"}]}}, {"key": "bubbleId:D:1", "value": {"type": 1, "text": "q"}}, {"key": "bubbleId:D:2", "value": {"type": 2, "text": "a", "timingInfo": {"clientStartTime": 5, "clientEndTime": 75}}}),
}


@pytest.mark.parametrize("harness", sorted(SMALL))
def test_each_format_gives_question_and_answer(harness):
    rows = parse_file("f", harness, SMALL[harness])
    said = [r for r in rows if r.get("role")]
    assert [r["role"] for r in said] == ["user", "assistant"] and [r["text"] for r in said] == ["q", "a"]
    assert {r["dialogue_id"] for r in rows} == {"D"} and said[0]["human_authored"] is True and said[1]["visible"] is True


@pytest.mark.parametrize("harness", sorted(PARSERS))
def test_nothing_and_nonsense_never_fail(harness):
    assert [r["diagnostic"] for r in parse_file("f", harness, "")] == ["empty_snapshot: no id and no messages"]
    odd = lines({"type": None}, {"type": "user", "message": 3}, {"payload": []}, {"key": 1, "value": []}, {"table": "message", "data": 1})
    assert parse_file("f", harness, odd + "\n[1]\nnull\n{")


def test_transcripts_over_frames(spark):
    files = spark.createDataFrame([(f"f{i}", h, bytearray(t.encode())) for i, (h, t) in enumerate({**SMALL, "codex": CODEX}.items())] + [("none", "omp", None)], "path string, harness string, content binary")
    rows = parse_transcripts(files).collect()
    assert {r.harness for r in rows if r.text == "a" or r.text == "done"} == {*SMALL, "codex"} and any(r.diagnostic and "empty_snapshot" in r.diagnostic for r in rows)


def test_lines_are_read_with_their_errors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\r\nbad\n')
    got = [(r.line, r.record, r.error) for r in read_lines(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [(1, '{"a": 1}', None), (3, None, "not a JSON object"), (4, None, "invalid JSON")]
    assert [n for n, _, _ in json_lines('{"a":1}\nx\n3')[1]] == [2, 3]
    assert time_ms("2026-01-01T00:00:00Z") == 1767225600000 and time_ms("x") is None and time_ms(True) is None


def test_sessions_part_at_gaps(spark):
    rows = spark.createDataFrame([("u", t) for t in ("2026-01-01 00:00:00", "2026-01-01 00:02:00", "2026-01-01 00:06:00")], "k string, t string").selectExpr("k", "cast(t as timestamp) as ts")
    assert sorted(r.n for r in sessions(rows, "k", "ts").collect()) == [1, 2]
