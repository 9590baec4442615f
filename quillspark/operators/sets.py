"""UNION and UNION ALL, by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(left: DataFrame, right: DataFrame, distinct: bool) -> DataFrame:
    both = left.unionByName(right, allowMissingColumns=True)
    return both.distinct() if distinct else both
