"""ORDER BY with explicit places for nulls."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column

from ..errors import QueryError


@dataclass(frozen=True)
class SortKey:
    by: object
    descending: bool = False
    nulls_first: bool = False

    def column(self, c: Column) -> Column:
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def directed(self, sign: int) -> SortKey:
        if sign not in (1, -1):
            raise QueryError("an order is 1 or -1")
        return replace(self, descending=sign < 0)

    def placed(self, sign: int) -> SortKey:
        if sign not in (1, -1):
            raise QueryError("a place of nulls is 1 (last) or -1 (first)")
        return replace(self, nulls_first=sign < 0)
