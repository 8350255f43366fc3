"""Permissive readers: a bad line or file becomes a diagnostic, never a failure."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCERPT = 120


def json_lines(text: str) -> tuple[list[tuple[int, dict]], list[tuple[int, str, str]]]:
    """(records with line numbers, errors with an excerpt) of one file's text."""
    records, errors = [], []
    for n, line in enumerate(re.split(r"\r?\n", text), 1):
        if not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError as e:
            errors.append((n, str(e), line[:EXCERPT]))
            continue
        if isinstance(value, dict):
            records.append((n, value))
        else:
            errors.append((n, "not a JSON object", line[:EXCERPT]))
    return records, errors


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, line, raw, record, error): one row for each line with text, split by Spark over all files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return records_of(files.select("path", F.decode("content", "UTF-8").alias("text")))


def records_of(files: DataFrame) -> DataFrame:
    """files(path, text) -> (path, line, record, error, excerpt): lines count from 1, and those without text are passed over."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")).filter(F.trim("raw") != "")
    record = F.expr("try_parse_json(raw)")
    is_object = F.coalesce(F.expr("schema_of_variant(try_parse_json(raw))").startswith("OBJECT"), F.lit(False))
    error = F.when(record.isNull(), "invalid JSON").when(~is_object, "not a JSON object")
    return lines.select("path", (F.col("line") + 1).alias("line"), F.when(error.isNull(), F.col("raw")).alias("record"), error.alias("error"), F.when(error.isNotNull(), F.substring("raw", 1, EXCERPT)).alias("excerpt"))


def is_sqlite(content) -> object:
    """Column: the file starts with the SQLite header."""
    return F.substring(content, 1, 16) == F.lit(b"SQLite format 3\x00")


def text_of(value) -> str | None:
    return value if isinstance(value, str) and value else None


def object_of(value) -> dict:
    return value if isinstance(value, dict) else {}


def list_of(value) -> list:
    return value if isinstance(value, list) else []


def number_of(value) -> float | None:
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf") else None


def time_ms(value) -> int | None:
    """ISO text or epoch milliseconds."""
    if isinstance(value, str):
        try:
            at = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return None
        return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)
    n = number_of(value)
    return None if n is None else int(n)
