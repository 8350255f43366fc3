"""Guards and ratios that usage figures share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(x: Column) -> Column:
    """The value where it is a number above 0, else 0 (also for NULL and NaN)."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (x > 0), x).otherwise(F.lit(0))


def safe_integer(x: Column) -> Column:
    """Truncated towards zero; 0 for NULL, NaN and infinities."""
    d = x.cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(finite, d.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def ratio(top: Column, bottom: Column) -> Column:
    """NULL where the denominator isn't above 0."""
    return F.when(bottom > 0, top / bottom)


def round6(x: Column) -> Column:
    """Six decimal places; NULL for what isn't finite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), F.round(d, 6))


def bounded_cache_share(inputs: Column, cached: Column) -> Column:
    """cached / inputs where it is a share, else NULL."""
    return F.when((inputs > 0) & (cached >= 0) & (cached <= inputs), cached / inputs)


def effective_active_ms(gap: Column, api: Column, wait: Column) -> Column:
    """The wait where there is one, else the larger of gap and API time."""
    return F.when(wait > 0, wait).otherwise(F.greatest(gap, api))


def backoff_ms(attempt: Column) -> Column:
    """10 s doubled with every attempt from the first, an hour at most."""
    return F.least(F.lit(10_000) * F.pow(F.lit(2.0), attempt - 1), F.lit(3_600_000.0)).cast("bigint")


def nearest_rank(column: str, p: float) -> Column:
    """Aggregate: the value of a named column at rank ceil(p n); exact, and NULL without values."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})").cast("double")


def lower_quantile(sorted_values: Column, q: float) -> Column:
    """The element at floor((n - 1) q) of a sorted array."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.element_at(sorted_values, (F.floor((n - 1) * F.lit(q)) + 1).cast("int")))


def without_replay(total: Column, replayed: Column) -> Column:
    """What is left of a figure when a replayed part of it is taken off; NULL where nothing is, or nothing was known."""
    rest = total - F.least(total, F.coalesce(replayed, F.lit(0)))
    return F.when(rest > 0, rest)
