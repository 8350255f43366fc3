"""Statistics of whole texts, one Arrow batch at a time: the inputs of quality rules and the quality classifier."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, SPACES, between, fixed_multipliers, utf8

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = (
    "n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_echo_words", "n_distinct_words", "n_upper", "n_digits", "n_exclaim", "n_bars", "n_periods", "n_long_words",
)

#: Model inputs: ratios of counts.  Every one is defined (0) for an empty text.
RATIOS = {
    "symbol_share": ("n_symbols", "n_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "echo_share": ("n_echo_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "exclaim_share": ("n_exclaim", "n_words"),
    "bar_share": ("n_bars", "n_words"),
    "period_share": ("n_periods", "n_words"),
    "mean_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "long_share": ("n_long_words", "n_words"),
    "line_count": ("n_lines", None),
    "word_count": ("n_words", None),
}
WINDOW = 5
_KEYS = fixed_multipliers(WINDOW + 1, 5)


def repeated_windows(codes: np.ndarray, doc: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per word: it lies in a window of ``width`` words that stands twice or more in its own text.

    Windows are keyed by 64 bits and compared word by word where keys meet; a clash falls back to exact ranks.
    """
    n = len(codes)
    flags = np.zeros(n, dtype=bool)
    if n < width:
        return flags
    m = n - width + 1
    inside = doc[:m] == doc[width - 1 :]
    with np.errstate(over="ignore"):
        key = doc[:m].astype(np.uint64) * _KEYS[width]
        for k in range(width):
            key += codes[k : k + m].astype(np.uint64) * _KEYS[k]
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    if len(order) < 2:
        return flags
    twin = key[order[1:]] == key[order[:-1]]
    left, right = order[:-1][twin], order[1:][twin]
    same = doc[left] == doc[right]
    for k in range(width):
        same &= codes[left + k] == codes[right + k]
    if not same.all():
        rows = np.stack([doc[at], *(codes[at + k] for k in range(width))], axis=1)
        _, rank, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        starts = at[count[rank.ravel()] > 1]
    else:
        starts = np.union1d(left, right)
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a batch; a null text counts as an empty one."""
    raw, at, _ = utf8(column)
    n = len(at) - 1
    out = {k: np.zeros(n, dtype=np.int64) for k in COUNTS}
    lead = (raw & 0xC0) != 0x80
    space = SPACES[raw]
    sums = {
        "n_chars": lead, "word_chars": lead & ~space, "n_symbols": np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)),
        "n_digits": (raw >= 48) & (raw <= 57), "n_exclaim": raw == 33, "n_bars": raw == 124, "n_periods": raw == 46,
    }
    # Upper case: A-Z, and the two-byte Latin-1 capitals C3 80 .. C3 9E.
    upper = (raw >= 65) & (raw <= 90)
    if len(raw) > 1:
        upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    sums["n_upper"] = upper
    for k, flag in sums.items():
        out[k] = between(flag, at)
    out["n_bytes"] = np.diff(at)
    codes_of: defaultdict[bytes, int] = defaultdict()
    codes_of.default_factory = codes_of.__len__
    codes, lengths = [], np.zeros(n, dtype=np.int64)
    data = raw.tobytes()
    for i in range(n):
        text = data[at[i] : at[i + 1]]
        words = text.split()
        lengths[i] = len(words)
        if not words:
            continue
        own = np.fromiter(map(codes_of.__getitem__, words), dtype=np.int64, count=len(words))
        codes.append(own)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_distinct_words"][i] = len(set(words))
    out["n_words"] = lengths
    if codes:
        codes = np.concatenate(codes)
        doc = np.repeat(np.arange(n), lengths)
        word_at = np.concatenate(([0], np.cumsum(lengths)))
        out["n_repeat_words"] = between(repeated_windows(codes, doc), word_at)
        echo = np.zeros(len(codes), dtype=bool)
        echo[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        out["n_echo_words"] = between(echo, word_at)
        size = np.fromiter(map(len, codes_of), dtype=np.int64, count=len(codes_of))
        out["n_long_words"] = between(size[codes] > 16, word_at)
    return out


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of model inputs for each text, in the order of RATIOS."""
    cols = []
    for top, bottom in RATIOS.values():
        x = counts[top].astype(np.float64)
        cols.append(x if bottom is None else np.divide(x, counts[bottom], out=np.zeros_like(x), where=counts[bottom] > 0))
    return np.stack(cols, axis=1) if cols else np.zeros((0, 0))


STATS_TYPE = "struct<" + ",".join(f"{k}:bigint" for k in COUNTS) + ">"


@arrow_function(STATS_TYPE)
def text_stats(text: pa.Array) -> pa.Array:
    counts = count_batch(text)
    return pa.StructArray.from_arrays([pa.array(counts[k], pa.int64()) for k in COUNTS], list(COUNTS))


def ratio_column(stats: str, name: str) -> Column:
    """A model input as a Spark expression over the struct column ``stats``; equals ``ratios``."""
    top, bottom = RATIOS[name]
    x = F.col(stats)[top].cast("double")
    if bottom is None:
        return x
    y = F.col(stats)[bottom]
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))
