"""Connected components of links by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

EDGE = "a long, b long"


@tidy
def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a task as stars: each node with the smallest that its links in this task reach."""
    for pdf in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        yield pd.DataFrame([(x, r) for x in list(up) if (r := root(x)) != x], columns=["a", "b"], dtype="int64")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Large: neighbours greater than a node go to the least of its neighbourhood; small: the others do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    near = both.join(least, "a")
    if large:
        out = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """links: a, b (distinct nodes). node, component (the smallest node reached), for nodes with a link."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = scratch.stash(edges.mapInPandas(_forest, EDGE).distinct(), f"{name}-0")
    mark = lambda e: e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
    before, i = mark(edges), 0
    while before[0]:
        i += 1
        edges = scratch.stash(_star(_star(edges, True), False), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
