"""Ranges of keys as Columns: what an index scan would cover is a predicate here, which Spark pushes to its sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """Values between two bounds; a bound of None is open to that side's infinity."""

    lower: object = None
    upper: object = None
    lower_open: bool = False
    upper_open: bool = False

    @classmethod
    def equal(cls, value) -> Range:
        return cls(value, value)

    def includes(self, v) -> bool:
        low = self.lower is None or v > self.lower or v == self.lower and not self.lower_open
        return low and (self.upper is None or v < self.upper or v == self.upper and not self.upper_open)

    @property
    def empty(self) -> bool:
        if self.lower is None or self.upper is None:
            return False
        return self.lower > self.upper or self.lower == self.upper and (self.lower_open or self.upper_open)

    def column(self, c: Column) -> Column:
        parts = []
        if self.lower is not None:
            parts.append(c > self.lower if self.lower_open else c >= self.lower)
        if self.upper is not None:
            parts.append(c < self.upper if self.upper_open else c <= self.upper)
        return reduce(Column.__and__, parts) if parts else c.isNotNull()


def union(c: Column, ranges: list[Range]) -> Column:
    return reduce(Column.__or__, [r.column(c) for r in ranges], F.lit(False))


def intersection(c: Column, ranges: list[Range]) -> Column:
    return reduce(Column.__and__, [r.column(c) for r in ranges], c.isNotNull())


def composite(parts: list[tuple[Column, Range]]) -> Column:
    """A prefix of key columns, equalities first and a range last."""
    return reduce(Column.__and__, [r.column(c) for c, r in parts], F.lit(True))
