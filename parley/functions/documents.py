"""JSON values, payload variants, skill names, aliases and host classes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings under which sources report one figure, in order of preference.
USAGE_KEYS = {
    "input_tokens": ("$.input_tokens", "$.inputTokens", "$.prompt_tokens", "$.promptTokenCount"),
    "cached_tokens": ("$.cached_input_tokens", "$.cacheRead", "$.cache_read_input_tokens", "$.cachedContentTokenCount"),
    "output_tokens": ("$.output_tokens", "$.outputTokens", "$.completion_tokens", "$.candidatesTokenCount"),
    "reasoning_tokens": ("$.reasoning_output_tokens", "$.reasoningTokens", "$.reasoning_tokens", "$.thoughtsTokenCount"),
}
# Path prefixes of the operating systems that a source path can come from.
HOST_PREFIXES = ((r"^/Users/([^/]+)/", "macos"), (r"^/home/([^/]+)/", "linux"), (r"^[A-Za-z]:\\Users\\([^\\]+)\\", "windows"), (r"^/root/", "linux-root"))


def usage_from_json(raw: Column) -> Column:
    """struct of the usage figures of a raw JSON object, whichever spelling it uses."""
    return F.struct(*(F.coalesce(*(F.get_json_object(raw, k).try_cast("bigint") for k in keys)).alias(name) for name, keys in USAGE_KEYS.items()))


def json_pointer(document: Column, pointer: str) -> Column:
    """The value at an RFC 6901 pointer as text, or NULL."""
    path = "$"
    for step in pointer.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        path += f"[{step}]" if step.isdigit() else f"['{step}']"
    return F.get_json_object(document, path)


def skill_name(arguments: Column) -> Column:
    """The skill of a tool call: its ``skill`` argument, single or double encoded, or the folder of a SKILL.md path."""
    inner = F.coalesce(F.get_json_object(arguments, "$.skill"), F.get_json_object(F.get_json_object(arguments, "$"), "$.skill"), F.get_json_object(F.get_json_object(F.concat(F.lit('{"v":'), arguments, F.lit("}")), "$.v"), "$.skill"))
    by_path = F.nullif(F.regexp_extract(arguments, r"([\w.-]+)/SKILL\.md", 1), F.lit(""))
    return F.coalesce(inner, by_path)


def canonical_json(raw: Column) -> Column:
    """The same JSON with keys sorted at every depth; NULL where it isn't JSON."""

    def sort(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return F.pandas_udf(sort, "string")(raw)


def alias(value: Column, key: str, prefix: str = "a") -> Column:
    """A stable alias under an export's key (HMAC-SHA-256 by its definition, so NULL stays NULL)."""
    block = key.encode()[:64].ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit(outer), digest), 256), 1, 16))


def host_class(path: Column) -> Column:
    """struct(system, user) that a source path names; ``unknown`` without one."""
    system, user = F.lit("unknown"), F.lit(None).cast("string")
    for pattern, name in reversed(HOST_PREFIXES):
        hit = path.rlike(pattern)
        system = F.when(hit, name).otherwise(system)
        user = F.when(hit, F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")) if "(" in pattern else F.lit("root")).otherwise(user)
    return F.struct(system.alias("system"), user.alias("user"))
