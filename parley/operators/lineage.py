"""Replay detection between a child's and a parent's usage streams."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.sequences import longest_runs

LEAST_RUN = 3


def shared_prefixes(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children(child, parent, i, key) with parents(parent, j, key): the longest run of equal usage that starts a child.

    An equi-join on the usage key, then islands along the diagonal; only runs that begin at the child's first event
    are replays, and three events at least make one.
    """
    pairs = children.join(parents, ["parent", "key"]).select("child", "i", "j")
    return longest_runs(pairs, "child", "i", "j", LEAST_RUN).filter("start_i = 1").select("child", F.col("run").alias("replayed"), "start_j")


def map_replays(messages: DataFrame, replays: DataFrame) -> DataFrame:
    """messages(child, sequence, key) with replays(child, n, key): marks the requests that replay parent usage.

    A child's requests are walked in order along what its parent leaves to expect.  A request takes the next expected
    event of its key; one that repeats the request just matched is a copy of it and is marked too, without moving on.
    The first request that finds no event ahead is the child's own work, and ends the walk.  Each key's places are kept
    sorted, so a request costs one bisection.
    """

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("sequence", kind="stable")
        places = defaultdict(list)
        for place, key in enumerate(right.sort_values("n", kind="stable")["key"]):
            places[key].append(place)
        at, end, last, hit = 0, len(right), None, []
        for key in left["key"]:
            own = places.get(key, [])
            i = bisect_left(own, at)
            copy = at < end and last is not None and key == last
            found = at < end and not copy and i < len(own)
            hit.append(copy or found)
            if found:
                at, last = own[i] + 1, key
            elif not copy:
                at = end
        return left.assign(replayed=hit)[["child", "sequence", "key", "replayed"]]

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    return messages.groupBy("child").cogroup(replays.groupBy("child")).applyInPandas(walk, f"child {kinds['child']}, sequence {kinds['sequence']}, key {kinds['key']}, replayed boolean")
