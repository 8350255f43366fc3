"""Transcript files of all formats: built from the conversations, read back by their parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.plans.tables import query, table
from parley.sources.files import ENDINGS, select_files
from parley.sources.jsonl import is_sqlite, records_of
from parley.sources.transcripts import parse_transcripts

_STAMP = "date_format(timestamp_seconds(1700000000 + turn), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_PARTS = "array(named_struct('type', 'text', 'text', text))"
_CACHED = "named_struct('input_tokens', 10, 'cache_read_input_tokens', turn, 'output_tokens', 5)"

#: For each format: the record that opens a file, and the records of a question and of an answer, as structs.  ``id`` is
#: the dialogue's, ``turns`` the turns of the file.  Every answer reports 10 + turn input tokens with the cache.
FILES = {
    "codex": (
        ["named_struct('type', 'session_meta', 'payload', named_struct('id', id))"],
        [f"named_struct('timestamp', {_STAMP}, 'type', 'response_item', 'payload', named_struct('type', 'message', 'role', 'user', 'content', array(named_struct('type', 'input_text', 'text', text))))", "named_struct('type', 'event_msg', 'payload', named_struct('type', 'user_message', 'message', text))"],
        [f"named_struct('timestamp', {_STAMP}, 'type', 'response_item', 'payload', named_struct('type', 'message', 'role', 'assistant', 'content', array(named_struct('type', 'output_text', 'text', text))))"]
        # The count comes twice, as it does when rate limits are told apart.
        + ["named_struct('type', 'event_msg', 'payload', named_struct('type', 'token_count', 'info', named_struct('at', turn, 'last_token_usage', named_struct('input_tokens', 10 + turn, 'cached_input_tokens', turn, 'output_tokens', 5))))"] * 2,
    ),
    "claude-code": (
        [],
        [f"named_struct('type', 'user', 'sessionId', id, 'timestamp', {_STAMP}, 'origin', named_struct('kind', 'human'), 'message', named_struct('content', text))"],
        # Two lines of one message.
        [f"named_struct('type', 'assistant', 'sessionId', id, 'timestamp', {_STAMP}, 'message', named_struct('id', concat('m', turn), 'content', {c}, 'usage', {_CACHED}))" for c in ("array(named_struct('type', 'thinking', 'thinking', 'so'))", _PARTS)],
    ),
    "claude-desktop": (
        [],
        [f"named_struct('type', 'user', 'session_id', id, '_audit_timestamp', {_STAMP}, 'message', named_struct('content', text))"],
        [f"named_struct('type', 'assistant', 'session_id', id, '_audit_timestamp', {_STAMP}, 'message', named_struct('content', {_PARTS}, 'usage', {_CACHED}))", "named_struct('type', 'result', 'session_id', id, 'duration_ms', 7)"],
    ),
    "opencode": (
        ["named_struct('table', 'session', 'id', id)"],
        *(
            [f"named_struct('table', 'message', 'id', concat('m', turn), 'time_created', turn, 'data', {data})", "named_struct('table', 'part', 'id', 'p', 'message_id', concat('m', turn), 'time_created', turn, 'data', named_struct('type', 'text', 'text', text))"]
            for data in ("named_struct('role', 'user')", "named_struct('role', 'assistant', 'tokens', named_struct('input', 10, 'output', 5, 'cache', named_struct('read', turn)))")
        ),
    ),
    "cursor": (
        ["named_struct('key', concat('composerData:', id), 'value', named_struct('fullConversationHeadersOnly', transform(turns, t -> named_struct('bubbleId', cast(t as string)))))"],
        *(
            [f"named_struct('key', concat('bubbleId:', id, ':', turn), 'value', named_struct('type', {kind}, 'text', text, 'createdAt', {_STAMP}, 'tokenCount', named_struct('inputTokens', 10 + turn, 'outputTokens', 5)))"]
            for kind in (1, 2)
        ),
    ),
    "qwen-code": (
        [],
        [f"named_struct('type', 'user', 'sessionId', id, 'timestamp', {_STAMP}, 'message', named_struct('parts', array(named_struct('text', text))))"],
        [f"named_struct('type', 'assistant', 'sessionId', id, 'timestamp', {_STAMP}, 'message', named_struct('parts', array(named_struct('text', text))), 'usageMetadata', named_struct('promptTokenCount', 10 + turn, 'cachedContentTokenCount', turn, 'candidatesTokenCount', 5))"],
    ),
    "kimi-code": (
        ["named_struct('type', 'metadata', 'time', 0, 'sessionId', id)"],
        ["named_struct('type', 'turn.prompt', 'time', 1000 + turn, 'origin', 'user', 'text', text)"],
        [
            f"named_struct('type', 'context.append_loop_event', 'time', 1000 + turn, 'event', {event})"
            for event in ("named_struct('type', 'step.begin')", "named_struct('type', 'content.part', 'text', text)", "named_struct('type', 'step.end', 'usage', named_struct('inputOther', 10, 'inputCacheRead', turn, 'output', 5))")
        ],
    ),
    "omp": (
        ["named_struct('type', 'session', 'id', id)"],
        [f"named_struct('type', 'message', 'timestamp', {_STAMP}, 'message', named_struct('role', 'user', 'content', {_PARTS}))"],
        [f"named_struct('type', 'message', 'timestamp', {_STAMP}, 'message', named_struct('role', 'assistant', 'content', {_PARTS}, 'usage', named_struct('input', 10, 'cacheRead', turn, 'output', 5)))"],
    ),
}


def _lines(records: list[str]) -> str:
    return "concat_ws('\\n', " + ", ".join(f"to_json({r})" for r in records) + ")" if records else "cast(null as string)"


def _said(spark, d):
    """Questions and answers.  Their number stands in each text, so that none is a repeat of another."""
    c = table(spark, d, "conversations").filter("role in ('user', 'assistant')")
    return c.select(F.concat(F.lit("c"), "conv_id").alias("id"), "turn", "role", F.concat(F.lit("#"), "turn", F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def transcript_files(spark, d, harness: str):
    """(path, harness, content): one file for each conversation."""
    head, question, answer = FILES[harness]
    line = F.expr(f"case when role = 'user' then {_lines(question)} else {_lines(answer)} end")
    turns = _said(spark, d).withColumn("line", line).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("rows"))
    files = turns.select("id", F.expr("rows.turn").alias("turns"), F.array_join("rows.line", "\n").alias("body"))
    return files.select(F.concat("id", F.lit(".jsonl")).alias("path"), F.lit(harness).alias("harness"), F.concat_ws("\n", F.expr(_lines(head)), "body").alias("content"))


_PARSED = """select 'c' || conv_id as dialogue_id, row_number() over (partition by conv_id order by turn) - 1 as sequence, role, role = 'user' as human, true as visible,
 md5('#' || turn || ' ' || coalesce(text, '')) as digest, case when role = 'assistant' then {tokens} end as input_tokens from conversations where role in ('user', 'assistant')"""


def _parser_query(name: str, harness: str) -> None:
    @query(name, _PARSED.format(tokens="10 + turn"))
    def run(spark, d):
        rows = parse_transcripts(transcript_files(spark, d, harness))
        return rows.select("dialogue_id", "sequence", "role", F.col("human_authored").alias("human"), "visible", F.md5("text").alias("digest"), F.col("usage.input_tokens").alias("input_tokens"))


for _i, _harness in enumerate(("codex", "claude-code", "claude-desktop", "opencode", "cursor", "qwen-code", "kimi-code", "omp"), 6):
    _parser_query(f"src_{_i:02d}_{_harness.replace('-', '_')}", _harness)


_BROKEN = "case turn % 3 when 0 then '{\"turn\":' || turn || '}' when 1 then '[' || turn || ']' else '{\"turn\":' end"


@query("src_04_json_lines", f"""select conv_id, row_number() over (partition by conv_id order by turn) as line, case turn % 3 when 1 then 'not a JSON object' when 2 then 'invalid JSON' end as error, case when turn % 3 = 0 then {_BROKEN} end as record, case when turn % 3 > 0 then {_BROKEN} end as excerpt from conversations""")
def src_04(spark, d):
    """Good lines, lines that hold no object, and broken ones, with their numbers."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_BROKEN).alias("raw"))
    files = c.groupBy("conv_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(turn, raw))), x -> x.raw)"), "\n").alias("text"))
    return records_of(files.select(F.col("conv_id").alias("path"), "text")).select(F.col("path").alias("conv_id"), F.col("line").cast("bigint").alias("line"), "error", "record", "excerpt")


@query("src_05_sqlite_files", "select page_id, page_id % 3 = 0 as is_sqlite from pages")
def src_05(spark, d):
    """Files that begin with the database header, with a part of it, or with a page's text."""
    head = F.when(F.col("page_id") % 3 == 0, F.lit(b"SQLite format 3\x00")).when(F.col("page_id") % 3 == 1, F.lit(b"SQLite format")).otherwise(F.lit(b""))
    return table(spark, d, "pages").select("page_id", is_sqlite(F.concat(head, F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")))).alias("is_sqlite"))


_NAMES = ("a/b.jsonl", "a/B.JSONL", "x.sqlite3", "a/.sqlite", "y.vscdb", "d/e.json", "wire.jsonl", "s/state.json", "._a.jsonl", "skills-plugin/a.jsonl", "q/rpm/z.db", "rpm/log.txt", "n.jsonl.gz")
_PATH = f"case page_id % {len(_NAMES)} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(_NAMES)) + " end"
_RULES = {h: " or ".join(f"ends_with(lower(path), '{e}')" for e in es) for h, es in ENDINGS.items()} | {
    "kimi-code": "parse_filename(path) in ('state.json', 'session_index.jsonl', 'wire.jsonl')",
    "claude-desktop": "not (starts_with(path, 'skills-plugin/') or contains(path, '/skills-plugin/') or contains(path, '/rpm/'))",
}


@query("src_03_file_predicates", " union all ".join(f"select page_id, path, '{h}' as harness from (select page_id, {_PATH} as path from pages) where ({r}) and not starts_with(parse_filename(path), '._')" for h, r in _RULES.items()))
def src_03(spark, d):
    """Files of each format among a listing; a file may belong to several."""
    listing, out = table(spark, d, "pages").select("page_id", F.expr(_PATH).alias("path")), None
    for h in _RULES:
        part = select_files(listing, h).select("page_id", "path", F.lit(h).alias("harness"))
        out = part if out is None else out.unionByName(part)
    return out
