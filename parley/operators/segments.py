"""Cuts documents into segments at headings, paragraphs and code fences.

A document is an array of lines.  Counting fence markers tells the kind of every line, and runs of lines of one kind are
the blocks.  Running sums of token estimates then place the cuts: each is found by bisection from the cut before it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters of a token, tokens that a segment aims at, and tokens that it never exceeds.
CHARS_PER_TOKEN, TARGET, MOST = 3.5, 6500, 8000
FENCE, HEADING = re.compile(r"^\s*```"), re.compile(r"^#{1,6}(?:\s|$)")
GAP = "\n\n"


def estimate(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN)


def line_kinds(lines: list[str]) -> list[tuple[str, int]]:
    """(kind, number) of each line: lines with the same kind and number that follow one another are one block.

    The markers before a line, with its own, tell its fence: an odd count is inside one, and a marker that makes the count
    even closes its fence.  A fence that nothing closes runs to the end.  Headings stand alone.
    """
    markers = list(accumulate(bool(FENCE.match(x)) for x in lines))
    out = []
    for i, (line, n) in enumerate(zip(lines, markers, strict=True)):
        closes = n > (markers[i - 1] if i else 0) and n % 2 == 0
        if n % 2 or closes:
            out.append(("fence", (n + 1) // 2))
        elif HEADING.match(line):
            out.append(("heading", i))
        else:
            out.append(("text" if line.strip() else "blank", 0))
    return out


def blocks(text: str) -> list[tuple[str, list[str]]]:
    """(kind, lines) of the blocks in order; blank lines only part them."""
    lines = text.split("\n")
    keyed = zip(line_kinds(lines), lines, strict=True)
    return [(kind, [line for _, line in run]) for (kind, _), run in groupby(keyed, key=lambda x: x[0]) if kind != "blank"]


def filled(weights: list[int], room: int) -> list[slice]:
    """Stretches in order whose weights sum to ``room`` at most; one weight over it stands alone."""
    sums, out, at = [0, *accumulate(weights)], [], 0
    while at < len(weights):
        end = max(at + 1, bisect_right(sums, sums[at] + room) - 1)
        out.append(slice(at, end))
        at = end
    return out


def fitted(kind: str, lines: list[str]) -> list[str]:
    """The texts of a block: itself, or parts within the target where it is over the limit.

    A line over the limit is cut by length; each part of a closed fence has the fence's markers.
    """
    whole = "\n".join(lines)
    if estimate(whole) <= MOST:
        return [whole]
    ends = ("", "")
    if kind == "fence" and len(lines) > 1 and FENCE.match(lines[-1]):
        ends, lines = (lines[0] + "\n", "\n" + lines[-1]), lines[1:-1]
    kept = estimate("".join(ends)) if ends[0] else 0
    width = max(1, int((MOST - kept) * CHARS_PER_TOKEN))
    parts = [line[i : i + width] for line in lines for i in range(0, max(1, len(line)), width)]
    return [ends[0] + "\n".join(parts[s]) + ends[1] for s in filled([estimate(p) + 1 for p in parts], TARGET - kept)]


def cut_places(sizes: list[int], headings: list[int]) -> list[int]:
    """The blocks that start a segment, after the first.

    From a start, the first block that would pass the target looks back for the last heading since the start and cuts
    there.  Without one the segment goes on, up to the next heading that has a block after it or to the limit.
    """
    gap, n = estimate(GAP), len(sizes)
    sums = [0, *accumulate(size + gap for size in sizes)]
    past = lambda start, most: max(start + 1, bisect_right(sums, sums[start] + gap + most) - 1)
    out, start = [], 0
    while True:
        over, full = past(start, TARGET), past(start, MOST)
        if over >= n:
            return out
        before = bisect_left(headings, over)
        if before and headings[before - 1] > start:
            start = headings[before - 1]
        elif before < len(headings) and headings[before] < min(full, n - 1):
            start = headings[before]
        elif full < n:
            start = full
        else:
            return out
        out.append(start)


def segment(text: str) -> list[str]:
    """Segments near TARGET and within MOST tokens; a cut prefers the last heading.  A short text is one segment as it is."""
    if estimate(text) <= TARGET:
        return [text]
    parts = [(kind, body) for kind, lines in blocks(text) for body in fitted(kind, lines)]
    places = cut_places([estimate(body) for _, body in parts], [i for i, (kind, _) in enumerate(parts) if kind == "heading"])
    return [GAP.join(body for _, body in parts[a:b]) for a, b in zip([0, *places], [*places, len(parts)], strict=True) if a < b]


def segment_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each segment: the document's other columns, segment_no, content and token_count."""
    kind = "array<string>"

    def cut(column: pa.Array) -> pa.Array:
        return pa.array([segment(t or "") for t in column.to_pylist()], pa.list_(pa.string()))

    rest = [c for c in docs.columns if c != text]
    out = docs.select(*rest, F.posexplode(_udf(cut, kind)(text)).alias("segment_no", "content"))
    return out.withColumn("token_count", F.ceil(F.length("content") / CHARS_PER_TOKEN).cast("bigint"))


def _udf(f, kind):
    f.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, kind)
