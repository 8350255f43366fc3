"""Text, identity and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mixed analyzer: character classes and camel case, lower-cased.
TOKEN_PATTERN = r"\p{Lu}?\p{Ll}+|\p{Lu}+|\p{Lo}+|\p{N}+"
CHARS_PER_TOKEN = 3.5
HEAD_HASH_BYTES = 64 * 1024
# Starts of texts that a tool inserts, by source.
AUTO_CONTEXT = {
    "codex": ("<environment_context>", "# Context from my IDE setup", "<permissions instructions>", "<user_instructions>"),
    "claude-code": ("<command-name>", "<command-message>", "<local-command-", "Caveat:", "<system-reminder"),
}
# How a text says how long the work took.
_UNITS = "h|hr|hrs|hour|hours|m|min|mins|minute|minutes|s|sec|secs|second|seconds"
WORKED_FOR = rf"(?i)\bWorked for\s+((?:(?:\d+(?:\.\d+)?)\s*(?:{_UNITS})\s*)+)"
WORKED_PART = rf"(?i)\d+(?:\.\d+)?\s*(?:{_UNITS})\b"


def analyze(text: Column) -> Column:
    """Tokens of a text in order, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN_PATTERN})"), F.lit(1)), F.lower)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def normalize_snippet(text: Column) -> Column:
    """Without emphasis marks and ellipses, white space collapsed, lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(text, "</?em>", ""), "…|\\.\\.\\.", " ")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def is_auto_context(text: Column, source: str) -> Column:
    """The text starts as one that the source inserts by itself."""
    prefixes, trimmed = AUTO_CONTEXT[source], F.ltrim(text)
    test = F.lit(False)
    for p in prefixes:
        test = test | trimmed.startswith(p)
    return test


def workspace_path(path: Column) -> Column:
    """Without trailing slashes; the root stays."""
    bare = F.regexp_replace(path, r"/+$", "")
    return F.when((bare == "") & (path != ""), F.lit("/")).otherwise(bare)


def identity_key(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix_sha256 of the parts."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(identity_key(*parts), 256))


def head_hash(size: Column, text: Column, n: int = HEAD_HASH_BYTES) -> Column:
    """SHA-256 of the size, a colon and the first n bytes."""
    return F.sha2(F.concat(F.encode(F.concat(size.cast("string"), F.lit(":")), "UTF-8"), F.substring(F.encode(text, "UTF-8"), 1, n)), 256)


def day_key(ts: Column, zone: str = "Europe/Berlin") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def month_key(day: Column) -> Column:
    return F.substring(day, 1, 7)


def inclusive_days(first: Column, last: Column) -> Column:
    return (F.datediff(last, first) + 1).cast("bigint")


def parse_timestamp(text: Column) -> Column:
    """ISO text, or epoch seconds or milliseconds by size; only the years 2000 to 2100, else NULL."""
    number = text.try_cast("double")
    epoch = F.when(number < 1e12, number * 1000).otherwise(number)
    ts = F.coalesce(F.when(number.isNotNull(), F.timestamp_millis(epoch.cast("bigint"))), F.try_to_timestamp(text))
    return F.when((F.year(ts) >= 2000) & (F.year(ts) <= 2100), ts)


def worked_for_ms(text: Column) -> Column:
    """Milliseconds of ``Worked for 1h 2m 3s``, in any of its spellings; NULL where the text doesn't say so or says zero."""
    body = F.regexp_extract(text, WORKED_FOR, 1)
    parts = F.regexp_extract_all(body, F.lit(f"({WORKED_PART})"), F.lit(1))

    def seconds(part: Column) -> Column:
        n, unit = F.regexp_extract(part, r"^[\d.]+", 0).cast("double"), F.lower(F.regexp_extract(part, r"([A-Za-z]+)$", 1))
        return n * F.when(unit.startswith("h"), 3600).when(unit.startswith("m"), 60).otherwise(1)

    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + seconds(p))
    return F.when((body != "") & (total > 0), F.floor(total * 1000 + 0.5).cast("bigint"))


def report_project(repository: Column, name: Column) -> Column:
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(clean(repository), clean(name), F.lit("unassigned"))
