"""Transcripts of coding agents as canonical messages.

Each format is a function from a file's records to messages; unknown events become messages of role ``unknown`` and a
warning, and never drop a dialogue.  A dialogue without an id and without messages is an ``empty_snapshot`` error.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from parley.functions.texts import AUTO_CONTEXT
from parley.sources.jsonl import json_lines, list_of, number_of, object_of, text_of, time_ms

MESSAGES = (
    "path string, harness string, dialogue_id string, sequence bigint, role string, human_authored boolean, visible boolean, model string, ts_ms bigint, text string,"
    " chunks array<struct<kind:string,content:string,tool_name:string,call_id:string>>,"
    " usage struct<scope:string,input_tokens:bigint,cached_tokens:bigint,write_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint>,"
    " duration_ms bigint, wait_ms bigint, turn_id string, diagnostic string"
)


def chunk(kind: str, content=None, tool_name=None, call_id=None) -> dict:
    if content is not None and not isinstance(content, str):
        content = json.dumps(content, ensure_ascii=False, sort_keys=True)
    return {"kind": kind, "content": content, "tool_name": tool_name, "call_id": call_id}


def usage(scope: str, input_tokens=None, cached=None, write=None, output=None, reasoning=None) -> dict | None:
    """Cached reads and writes are parts of the input, reasoning is a part of the output: neither is added again."""
    values = [number_of(x) for x in (input_tokens, cached, write, output, reasoning)]
    if all(v is None for v in values):
        return None
    i, c, w, o, r = (None if v is None else int(v) for v in values)
    total = None if i is None and o is None else (i or 0) + (o or 0)
    return {"scope": scope, "input_tokens": i, "cached_tokens": c, "write_tokens": w, "output_tokens": o, "reasoning_tokens": r, "total_tokens": total}


def inclusive_usage(scope: str, plain, cached, write, output, reasoning=None) -> dict | None:
    """For formats whose input excludes the cache."""
    parts = [number_of(x) for x in (plain, cached, write)]
    whole = None if all(p is None for p in parts) else sum(p or 0 for p in parts)
    return usage(scope, whole, cached, write, output, reasoning)


class Dialogue:
    def __init__(self):
        self.id: str | None = None
        self.messages: list[dict] = []
        self.model: str | None = None
        self.warnings: list[str] = []

    def add(self, role: str, chunks: list[dict], ts=None, human=None, visible=True, **more) -> dict:
        text = "\n".join(c["content"] for c in chunks if c["kind"] == "text" and c["content"])
        row = {"role": role, "chunks": chunks, "text": text or None, "ts_ms": ts, "human_authored": human, "visible": visible, "model": self.model if role == "assistant" else None} | more
        self.messages.append(row)
        return row

    def unknown(self, what: str, value, ts=None) -> None:
        self.warnings.append(f"unknown event {what}")
        self.add("unknown", [chunk("unknown", value)], ts, visible=False)


def is_auto(text: str | None, source: str) -> bool:
    return bool(text) and text.lstrip().startswith(AUTO_CONTEXT[source])


def blocks_of(content) -> list[dict]:
    """Text, thinking and tool blocks of the common message shape."""
    if isinstance(content, str):
        return [chunk("text", content)]
    out = []
    for b in map(object_of, list_of(content)):
        kind = b.get("type")
        if kind in ("text", "input_text", "output_text"):
            out.append(chunk("text", b.get("text") or ""))
        elif kind in ("thinking", "reasoning"):
            out.append(chunk("thought", b.get("thinking") or b.get("text") or ""))
        elif kind in ("tool_use", "toolCall"):
            out.append(chunk("tool_call", b.get("input", b.get("arguments")), b.get("name"), b.get("id")))
        elif kind == "tool_result":
            out.append(chunk("tool_result", b.get("content"), None, b.get("tool_use_id")))
        elif kind == "image":
            out.append(chunk("attachment", None))
        else:
            out.append(chunk("unknown", b))
    return out


def codex(records) -> Dialogue:
    """Rollout events; token counts repeated for rate-limit buckets count once, and a turn's wait runs from start to end."""
    d, last_count, turn, users, answers = Dialogue(), None, None, [], set()
    started = None
    for _, r in records:
        ts, p, kind = time_ms(r.get("timestamp")), object_of(r.get("payload")), r.get("type")
        what = p.get("type")
        if kind == "session_meta":
            d.id = d.id or text_of(p.get("id"))
            started = started if started is not None else time_ms(p.get("timestamp"))
        elif kind == "turn_context":
            d.model = text_of(p.get("model")) or d.model
        elif kind == "response_item" and what == "message":
            role, chunks = p.get("role") or "unknown", blocks_of(p.get("content"))
            own = [c for c in chunks if c["kind"] == "text" and not is_auto(c["content"], "codex")]
            if role == "user":
                users.append(d.add("user", chunks, ts, None if own else False, bool(own), turn_id=turn and turn["id"]))
            else:
                row = d.add(role, chunks, ts, False, role == "assistant", turn_id=turn and turn["id"])
                if role == "assistant":
                    answers.add(row["text"])
        elif kind == "response_item" and what == "reasoning":
            d.add("assistant", [chunk("thought", x.get("text")) for x in map(object_of, list_of(p.get("summary")))], ts, False, False)
        elif kind == "response_item" and what in ("function_call", "custom_tool_call"):
            d.add("assistant", [chunk("tool_call", p.get("arguments", p.get("input")), p.get("name"), p.get("call_id"))], ts, False, False)
        elif kind == "response_item" and str(what).endswith("_output"):
            d.add("tool", [chunk("tool_result", p.get("output"), None, p.get("call_id"))], ts, False, False)
        elif kind == "event_msg" and what == "user_message":
            said = text_of(p.get("message")) or ""
            match = next((m for m in reversed(users) if m["human_authored"] is not True and said and said in (m["text"] or "")), None)
            if match is None:
                match = d.add("user", [chunk("text", said)], ts, True, turn_id=turn and turn["id"])
                users.append(match)
            match["human_authored"], match["visible"] = True, True
        elif kind == "event_msg" and what == "agent_message":
            said = chunk("text", p.get("message"))
            if said["content"] not in answers:  # the event may repeat an answer that stands anywhere before it
                answers.add(d.add("assistant", [said], ts, False)["text"])
        elif kind == "event_msg" and what == "token_count":
            info = object_of(p.get("info"))
            key = json.dumps(info, sort_keys=True)
            u = object_of(info.get("last_token_usage"))
            if u and key != last_count:
                target = next((m for m in reversed(d.messages) if m["role"] == "assistant"), None)
                if target is not None:
                    new = usage("request", u.get("input_tokens"), u.get("cached_input_tokens"), None, u.get("output_tokens"), u.get("reasoning_output_tokens"))
                    old = target.get("usage")
                    if old and new:
                        new = {k: v if k == "scope" else (old[k] or 0) + (v or 0) if old[k] is not None or v is not None else None for k, v in new.items()}
                    target["usage"] = new or old
            last_count = key
        elif kind == "event_msg" and what == "task_started":
            turn = {"id": text_of(p.get("turn_id")) or f"turn-{len(d.messages)}", "start": ts, "from": len(d.messages)}
        elif kind == "event_msg" and what in ("task_complete", "turn_aborted") and turn:
            took = number_of(p.get("duration_ms"))
            if took is None and ts is not None and turn["start"] is not None:
                took = ts - turn["start"]
            if took is not None and not (started and ts and ts < started - 5000):
                for m in d.messages[turn["from"] :]:
                    if m["role"] == "user" and m["human_authored"]:
                        m["wait_ms"] = int(took)
            turn = None
        elif kind == "event_msg" and what in ("thread_settings_applied", "agent_reasoning"):
            d.model = text_of(object_of(p.get("thread_settings")).get("model")) or d.model
        elif kind == "compacted":
            d.add("system", [chunk("object", p)], ts, False, False)
        else:
            d.unknown(f"{kind}/{what}", p, ts)
    return d


def claude_code(records) -> Dialogue:
    """Lines of one API message are one message; its usage counts once."""
    d, by_id = Dialogue(), {}
    for _, r in records:
        ts, m, kind = time_ms(r.get("timestamp")), object_of(r.get("message")), r.get("type")
        d.id = d.id or text_of(r.get("sessionId"))
        if kind == "user":
            chunks = blocks_of(m.get("content"))
            only_tools = bool(chunks) and all(c["kind"] == "tool_result" for c in chunks)
            own = any(c["kind"] == "text" and not is_auto(c["content"], "claude-code") for c in chunks)
            origin = object_of(r.get("origin")).get("kind")
            human = False if r.get("isMeta") or only_tools else True if origin == "human" else False if origin else None if own else False
            d.add("tool" if only_tools else "user", chunks, ts, human, not (only_tools or r.get("isMeta") or not own or r.get("isSidechain")), turn_id=text_of(r.get("promptId")))
        elif kind == "assistant":
            d.model = text_of(m.get("model")) or d.model
            u = object_of(m.get("usage"))
            key = m.get("id")
            if key in by_id:
                row = by_id[key]
                row["chunks"] += blocks_of(m.get("content"))
                row["text"] = "\n".join(c["content"] for c in row["chunks"] if c["kind"] == "text" and c["content"]) or None
                row["ts_ms"] = min((t for t in (row["ts_ms"], ts) if t is not None), default=None)
            else:
                row = d.add("assistant", blocks_of(m.get("content")), ts, False, not r.get("isSidechain"))
                if key:
                    by_id[key] = row
            row["usage"] = inclusive_usage("request", u.get("input_tokens"), u.get("cache_read_input_tokens"), u.get("cache_creation_input_tokens"), u.get("output_tokens")) or row.get("usage")
        elif kind in ("system", "attachment", "queue-operation", "custom-title", "last-prompt", "mode", "summary"):
            if kind == "system":
                d.add("system", [chunk("text", text_of(r.get("content")))], ts, False, False)
        else:
            d.unknown(str(kind), r, ts)
    return d


def claude_desktop(records) -> Dialogue:
    """Audit events; a result closes a turn and gives its duration to the last main-chain answer."""
    d, last = Dialogue(), None
    for _, r in records:
        ts, m, kind, side = time_ms(r.get("_audit_timestamp")), object_of(r.get("message")), r.get("type"), r.get("parent_tool_use_id") is not None
        d.id = d.id or text_of(r.get("session_id"))
        if kind == "user":
            chunks = blocks_of(m.get("content"))
            tools = bool(chunks) and all(c["kind"] == "tool_result" for c in chunks)
            d.add("tool" if tools else "user", chunks, ts, not side and not tools, not side and not tools)
        elif kind == "assistant":
            d.model = text_of(m.get("model")) or d.model
            u = object_of(m.get("usage"))
            row = d.add("assistant", blocks_of(m.get("content")), ts, False, not side, usage=inclusive_usage("request", u.get("input_tokens"), u.get("cache_read_input_tokens"), u.get("cache_creation_input_tokens"), u.get("output_tokens")))
            row["visible"] = not side and bool(row["text"])
            last = last if side else row
        elif kind == "result" and last is not None:
            took = number_of(r.get("duration_ms"))
            last["duration_ms"], last = None if took is None else int(took), None
        elif kind not in ("system", "rate_limit_event", "result"):
            d.unknown(str(kind), r, ts)
    return d


def qwen_code(records) -> Dialogue:
    d = Dialogue()
    for _, r in records:
        ts, m, kind, sub = time_ms(r.get("timestamp")), object_of(r.get("message")), r.get("type"), r.get("subtype")
        d.id = d.id or text_of(r.get("agentId")) or text_of(r.get("sessionId"))
        chunks = []
        for p in map(object_of, list_of(m.get("parts"))):
            if "functionCall" in p:
                chunks.append(chunk("tool_call", object_of(p["functionCall"]).get("args"), object_of(p["functionCall"]).get("name"), object_of(p["functionCall"]).get("id")))
            elif "functionResponse" in p:
                chunks.append(chunk("tool_result", object_of(p["functionResponse"]).get("response"), object_of(p["functionResponse"]).get("name"), object_of(p["functionResponse"]).get("id")))
            elif "text" in p:
                chunks.append(chunk("thought" if p.get("thought") else "text", p.get("text")))
        side = bool(r.get("isSidechain")) or sub == "cron"
        if kind == "user":
            d.add("user", chunks, ts, False if side else True if sub in (None, "mid-turn") else None, not side)
        elif kind == "assistant":
            d.model, u = text_of(r.get("model")) or d.model, object_of(r.get("usageMetadata"))
            d.add("assistant", chunks, ts, False, not side, usage=usage("request", u.get("promptTokenCount"), u.get("cachedContentTokenCount"), None, u.get("candidatesTokenCount"), u.get("thoughtsTokenCount")))
        elif kind == "tool_result":
            res = object_of(r.get("toolCallResult"))
            d.add("tool", chunks or [chunk("tool_result", res.get("resultDisplay"), None, res.get("callId"))], ts, False, False)
        elif kind != "system":
            d.unknown(str(kind), r, ts)
    return d


def kimi_code(records) -> Dialogue:
    """Wires of all agents merged by time; records may carry ``_agent``, the wire they come from."""
    d, step, seen = Dialogue(), None, set()
    order = sorted(enumerate(records), key=lambda x: (time_ms(x[1][1].get("time")) is None, time_ms(x[1][1].get("time")) or 0, str(x[1][1].get("_agent", "")), x[0]))
    for _, (_, r) in order:
        ts, kind, sub = time_ms(r.get("time")), r.get("type"), r.get("_agent", "main") not in ("main", None)
        e = object_of(r.get("event")) or r
        if kind == "metadata":
            d.id = d.id or text_of(r.get("sessionId"))
        elif kind in ("config.update", "llm.request"):
            d.model = text_of(r.get("model")) or d.model
        elif kind == "turn.prompt":
            said, origin = text_of(r.get("text")) or text_of(r.get("input")) or "", r.get("origin", "user")
            if (said, sub) not in seen:
                seen.add((said, sub))
                human = False if sub or origin in ("system_trigger", "background_task", "subagent") else True if origin == "user" else None
                d.add("user", [chunk("text", said)], ts, human, human)
        elif kind == "context.append_loop_event":
            what = e.get("type") if e is not r else r.get("eventType")
            if what == "step.begin":
                step = d.add("assistant", [], ts, False, not sub)
            elif what in ("content.part", "tool.call") and step is not None:
                part = chunk("tool_call", e.get("arguments"), e.get("name"), e.get("callId")) if what == "tool.call" else chunk("thought" if e.get("thought") else "text", e.get("text"))
                step["chunks"].append(part)
                step["text"] = "\n".join(c["content"] for c in step["chunks"] if c["kind"] == "text" and c["content"]) or None
            elif what == "tool.result":
                d.add("tool", [chunk("tool_result", e.get("output"), None, e.get("callId"))], ts, False, False)
            elif what == "step.end" and step is not None:
                u = object_of(e.get("usage"))
                step["usage"], step = inclusive_usage("request", u.get("inputOther"), u.get("inputCacheRead"), u.get("inputCacheCreation"), u.get("output")), None
        elif kind not in ("context.append_message", "usage.record"):
            d.unknown(str(kind), r, ts)
    return d


def omp(records) -> Dialogue:
    d = Dialogue()
    for _, r in records:
        ts, kind, m = time_ms(r.get("timestamp")), r.get("type"), object_of(r.get("message"))
        if kind == "session":
            d.id = d.id or text_of(r.get("id"))
        elif kind == "model_change":
            d.model = text_of(r.get("model")) or d.model
        elif kind == "message":
            role, u = m.get("role"), object_of(m.get("usage"))
            if role == "assistant":
                d.model = text_of(m.get("model")) or d.model
                took = number_of(m.get("duration"))
                d.add("assistant", blocks_of(m.get("content")), ts, False, True, duration_ms=None if took is None else int(took), usage=inclusive_usage("request", u.get("input"), u.get("cacheRead"), u.get("cacheWrite"), u.get("output"), u.get("reasoningTokens")))
            elif role == "toolResult":
                d.add("tool", [chunk("tool_result", m.get("content"), None, m.get("toolCallId"))], ts, False, False)
            elif role == "user":
                d.add("user", blocks_of(m.get("content")), ts, m.get("attribution") != "agent", True)
            else:
                d.unknown(f"message/{role}", m, ts)
        elif kind == "custom":
            d.add("system", [chunk("object", r)], ts, False, bool(r.get("display")))
        elif kind not in ("title", "thinking_level_change"):
            d.unknown(str(kind), r, ts)
    return d


def opencode(records) -> Dialogue:
    """Rows of its three tables as records with ``table``; parts are ordered by time, then id."""
    d, parts = Dialogue(), {}
    rows = [r for _, r in records]
    for r in rows:
        if r.get("table") == "session":
            d.id = d.id or text_of(r.get("id"))
        elif r.get("table") == "part":
            parts.setdefault(r.get("message_id"), []).append(r)
    for r in sorted((r for r in rows if r.get("table") == "message"), key=lambda r: (number_of(r.get("time_created")) or 0, str(r.get("id")))):
        data, chunks = object_of(r.get("data")), []
        for p in sorted(parts.get(r.get("id"), []), key=lambda p: (number_of(p.get("time_created")) or 0, str(p.get("id")))):
            x = object_of(p.get("data"))
            if x.get("type") == "text":
                chunks.append(chunk("text", x.get("text")))
            elif x.get("type") == "reasoning":
                chunks.append(chunk("thought", x.get("text")))
            elif x.get("type") == "tool":
                s = object_of(x.get("state"))
                chunks += [chunk("tool_call", s.get("input"), x.get("tool"), x.get("callID")), chunk("tool_result", s.get("output"), x.get("tool"), x.get("callID"))]
        role, t = data.get("role"), object_of(data.get("tokens"))
        d.model = text_of(data.get("modelID")) or d.model
        cache = object_of(t.get("cache"))
        human = (None if "format" in data else True) if role == "user" else False
        d.add(role or "unknown", chunks, time_ms(r.get("time_created")), human, True if role else None, usage=inclusive_usage("request", t.get("input"), cache.get("read"), cache.get("write"), t.get("output"), t.get("reasoning")))
    return d


def cursor(records) -> Dialogue:
    """Key-value rows; a composer lists its bubbles in order, and a missing bubble is a warning."""
    d, bubbles, heads = Dialogue(), {}, []
    for _, r in records:
        key = str(r.get("key", "")).split(":")
        if key[0] == "composerData":
            d.id = d.id or key[1]
            heads = list_of(object_of(r.get("value")).get("fullConversationHeadersOnly"))
        elif key[0] == "bubbleId" and len(key) == 3:
            bubbles[key[2]] = object_of(r.get("value"))
    start, user = None, None
    for h in map(object_of, heads):
        b = bubbles.get(str(h.get("bubbleId")))
        if b is None:
            d.warnings.append(f"missing bubble {h.get('bubbleId')}")
            continue
        ts, count = time_ms(b.get("createdAt")), object_of(b.get("tokenCount"))
        if b.get("type") == 1:
            user, start = d.add("user", [chunk("text", b.get("text"))], ts, True, True), None
            continue
        tool = object_of(b.get("toolFormerData"))
        chunks = [chunk("text", b["text"])] if b.get("text") else []
        if tool:
            chunks.append(chunk("tool_call", tool.get("params"), tool.get("name"), tool.get("toolCallId")))
        d.add("assistant", chunks, ts, False, bool(b.get("text")) if tool else not b.get("isThought"), usage=usage("request", count.get("inputTokens"), None, None, count.get("outputTokens")))
        if tool and "result" in tool:
            d.add("tool", [chunk("tool_result", tool["result"], tool.get("name"), tool.get("toolCallId"))], ts, False, False)
        timing = object_of(b.get("timingInfo"))
        a, z = number_of(timing.get("clientStartTime")), number_of(timing.get("clientEndTime"))
        if user is not None and a is not None and z is not None:
            start = (min(start[0], a), max(start[1], z)) if start else (a, z)
            user["wait_ms"] = int(start[1] - start[0])
    return d


PARSERS: dict[str, Callable] = {
    "codex": codex, "claude-code": claude_code, "claude-desktop": claude_desktop, "opencode": opencode,
    "cursor": cursor, "qwen-code": qwen_code, "kimi-code": kimi_code, "omp": omp,
}


def parse_file(path: str, harness: str, text: str) -> list[dict]:
    """The canonical rows of one file; errors and warnings are rows of their own, without a role."""
    records, errors = json_lines(text)
    d = PARSERS[harness](records)
    base = {"path": path, "harness": harness, "dialogue_id": d.id}
    rows = [base | m | {"sequence": i} for i, m in enumerate(d.messages)]
    notes = [f"line {n}: {e}" for n, e, _ in errors] + d.warnings
    if d.id is None and not d.messages:
        notes.append("empty_snapshot: no id and no messages")
    return rows + [base | {"diagnostic": x} for x in notes]


_ARROW = pa.schema([
    ("path", pa.string()), ("harness", pa.string()), ("dialogue_id", pa.string()), ("sequence", pa.int64()), ("role", pa.string()), ("human_authored", pa.bool_()),
    ("visible", pa.bool_()), ("model", pa.string()), ("ts_ms", pa.int64()), ("text", pa.string()),
    ("chunks", pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "content", "tool_name", "call_id")]))),
    ("usage", pa.struct([("scope", pa.string()), *((c, pa.int64()) for c in ("input_tokens", "cached_tokens", "write_tokens", "output_tokens", "reasoning_tokens", "total_tokens"))])),
    ("duration_ms", pa.int64()), ("wait_ms", pa.int64()), ("turn_id", pa.string()), ("diagnostic", pa.string()),
])


def parse_transcripts(files: DataFrame) -> DataFrame:
    """files(path, harness, content as binary or text) -> canonical rows; files are independent of one another."""

    def run(batches):
        for b in batches:
            for path, harness, content in zip(b.column("path").to_pylist(), b.column("harness").to_pylist(), b.column("content").to_pylist(), strict=True):
                text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content or ""
                rows = [{k: r.get(k) for k in _ARROW.names} for r in parse_file(path, harness, text)]
                for a in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 1024], schema=_ARROW)

    return files.select("path", "harness", "content").mapInArrow(run, MESSAGES)
