"""Usage accumulation: one aggregation pass of conditional sums, and the figures that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.numbers import bounded_cache_share, nearest_rank, positive, ratio, round6


def measures() -> dict[str, Column]:
    """Sums and counts over message rows (see plans.tables.MESSAGE_COLUMNS for the columns)."""
    c = F.col
    i, r, w = positive(c("input_tokens")), positive(c("cached_tokens")), positive(c("write_tokens"))
    used, valid = c("has_usage"), c("has_usage") & (positive(c("cached_tokens")) + positive(c("write_tokens")) <= positive(c("input_tokens")))
    total = lambda x, when=None: F.coalesce(F.sum(x if when is None else F.when(when, x)), F.lit(0)).cast("bigint")
    chars = c("content_chars")
    return {
        "messages": F.count(F.lit(1)),
        "responses": F.count("model_key"),
        "content_chars": total(chars),
        "assistant_chars": total(chars, c("role") == "assistant"),
        "user_chars": total(chars, c("role") == "user"),
        "tool_chars": total(chars, c("role") == "tool"),
        "usage_messages": F.count_if(used),
        "estimated_usage_messages": F.count_if(c("is_estimated")),
        "input_tokens": total(i, used),
        "cached_tokens": total(r, used),
        "write_tokens": total(w, used),
        "uncached_tokens": total(i - r - w, valid),
        "breakdown_input_tokens": total(i, valid),
        "classified_cached_tokens": total(r, valid),
        "classified_write_tokens": total(w, valid),
        "breakdown_messages": F.count_if(valid),
        "invalid_breakdown_messages": F.count_if(used & ~valid),
        "output_tokens": total(positive(c("output_tokens")), used),
        "reasoning_tokens": total(positive(c("reasoning_tokens")), used),
        "total_tokens": total(positive(c("total_tokens")), used),
        "duration_count": F.count_if(c("duration_ms") > 0),
        "duration_ms": total(positive(c("duration_ms"))),
        "ttft_count": F.count_if(c("ttft_ms") > 0),
        "reported_count": F.count_if(c("reported_ms") > 0),
        "reported_ms": total(positive(c("reported_ms"))),
        "reported_cost_messages": F.count_if(c("cost") > 0),
        "reported_cost": F.round(F.coalesce(F.sum(positive(c("cost"))), F.lit(0.0)), 6),
    }


def accumulate(messages: DataFrame, *keys: str) -> DataFrame:
    return messages.groupBy(*keys).agg(*(m.alias(k) for k, m in measures().items()), F.countDistinct("dialogue_id").alias("dialogues"))


def percentiles() -> dict[str, Column]:
    """Nearest-rank percentiles of the positive values."""
    out = {}
    for c in ("duration_ms", "ttft_ms", "reported_ms"):
        for p in (50, 90):
            out[f"{c}_p{p}"] = nearest_rank(f"case when {c} > 0 then {c} end", p / 100)
    return out


def finalize(groups: DataFrame) -> DataFrame:
    """Shares, coverages and averages of accumulated groups; NULL on an empty denominator."""
    c = F.col
    rates = {
        "breakdown_coverage": ratio(c("breakdown_input_tokens"), c("input_tokens")),
        "tokens_per_usage_message": ratio(c("total_tokens"), c("usage_messages")),
        "output_per_usage_message": ratio(c("output_tokens"), c("usage_messages")),
        "output_share": ratio(c("output_tokens"), c("total_tokens")),
        "reasoning_share": ratio(c("reasoning_tokens"), c("output_tokens")),
        "cache_share": bounded_cache_share(c("input_tokens"), c("cached_tokens")),
        "raw_cache_ratio": ratio(c("cached_tokens"), c("input_tokens")),
        "chars_per_1k_tokens": ratio(c("content_chars") * 1000.0, c("total_tokens")),
        "duration_hours": c("duration_ms") / 3_600_000,
        "duration_coverage": ratio(c("duration_count"), c("responses")),
        "reported_cost_coverage": ratio(c("reported_cost_messages"), c("responses")),
    }
    return groups.withColumns({k: round6(v) for k, v in rates.items()})


def turn_waits(messages: DataFrame, *keys: str) -> DataFrame:
    """The longest wait of each turn of human-authored messages, by keys; a message without turn is its own."""
    turn = F.coalesce(F.concat(F.col("dialogue_id"), F.lit(":"), F.col("wait_turn")), F.concat(F.lit("m"), F.col("message_id")))
    rows = messages.filter(F.col("human_authored") & (F.col("wait_ms") > 0))
    return rows.groupBy(*keys, turn.alias("turn")).agg(F.max("wait_ms").alias("wait_ms"))


def wait_sums(messages: DataFrame, *keys: str) -> DataFrame:
    waits = turn_waits(messages, *keys).groupBy(*keys)
    return waits.agg(F.count(F.lit(1)).alias("wait_turns"), F.sum("wait_ms").alias("wait_ms"), nearest_rank("wait_ms", 0.5).alias("wait_p50"), nearest_rank("wait_ms", 0.9).alias("wait_p90"))
