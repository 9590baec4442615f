"""Rows with aliases: what a FROM list and its joins make, and how expressions see it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AliasError, QueryError
from ..functions.text import Expr, bind, chains, tokens
from ..sources.store import HIDDEN


@dataclass
class Scope:
    """df and the columns of each alias; no aliases once rows are projected. outer: aliases of the rows that a lateral
    sub-query is run for."""

    df: DataFrame
    aliases: dict[str, list[str]] = field(default_factory=dict)
    outer: frozenset[str] = frozenset()

    def columns_of(self, alias: str) -> list[str]:
        return [c for c in self.aliases[alias] if c not in HIDDEN]

    def whole_row(self, alias: str) -> list[Column]:
        return [F.col(f"`{alias}`.`{c}`") for c in self.columns_of(alias)]

    def check(self, text: str, variables: frozenset[str] = frozenset()) -> None:
        """References must name a known alias, or a column."""
        if not self.aliases:
            return
        columns = {c.lower() for cs in self.aliases.values() for c in cs}
        known = {a.lower() for a in {*self.aliases, *self.outer}}
        for _, _, names in chains(tokens(text)):
            head = names[0].lower()
            if len(names) > 1 and head not in known and head not in columns and head not in variables and "->" not in text:
                raise AliasError(f"unknown alias {names[0]} in: {text}")

    def reads_outer(self, text: str) -> bool:
        return bool(self.outer) and any(len(names) > 1 and names[0] in self.outer for _, _, names in chains(tokens(text)))

    def column(self, e, params: dict) -> Column:
        if isinstance(e, Column):
            return e
        if isinstance(e, Expr):
            return self.parsed(bind(e, params))
        out = e(Params(params))
        if not isinstance(out, Column):
            raise QueryError("a callable clause must return a Column")
        return out

    def parsed(self, text: str) -> Column:
        """Text that is bound already."""
        self.check(text)
        c = F.expr(self.rows_as_structs(text))
        return c.outer() if self.reads_outer(text) else c

    def rows_as_structs(self, text: str, at: dict[tuple[str, str], str] | None = None) -> str:
        """A bare alias inside an expression is its whole row. at: where columns are instead, by alias and lower-case name."""
        toks = tokens(text)
        columns = {c.lower() for cs in self.aliases.values() for c in cs}
        by_lower = {a.lower(): a for a in self.aliases}
        out, done = [], 0
        for i, j, names in chains(toks):
            a = by_lower.get(names[0].lower())
            if len(names) == 1 and a and names[0].lower() not in columns:
                out += toks[done:i]
                out.append("struct(" + ", ".join(f"{at[a, c.lower()]} AS `{c}`" if at else f"`{a}`.`{c}`" for c in self.columns_of(a)) + ")")
                done = j
            elif at and a and len(names) > 1 and (a, names[1].lower()) in at:
                out += [*toks[done:i], at[a, names[1].lower()]]
                done = i + 3
        return "".join([*out, *toks[done:]])

    def select(self, items, params: dict) -> DataFrame:
        """items: (name or None, expression). One item without name: a bare alias is its row's columns, else `value`."""
        out: list[Column] = []
        for name, e in items:
            if name is None and isinstance(e, Expr):
                text = bind(e, params).strip()
                if text == "*":
                    out += [F.col(f"`{c}`") for c in self.df.columns if c not in HIDDEN] if not self.aliases else [c for a in self.aliases for c in self.whole_row(a)]
                    continue
                if text in self.aliases:
                    out += self.whole_row(text)
                    continue
                if text.endswith(".*") and text[:-2] in self.aliases:
                    out += self.whole_row(text[:-2])
                    continue
                plain = next(iter(chains(tokens(text))), (0, 0, []))
                full = plain[0] == 0 and plain[1] == len(tokens(text))
                out.append(self.column(e, params).alias(plain[2][-1] if full and len(items) > 1 else "value"))
            else:
                c = self.column(e, params)
                out.append(c if name is None else c.alias(name))
        return self.df.select(*out)


class Params:
    """Named parameters as literal Columns, by attribute or item."""

    def __init__(self, values: dict):
        self._values = values

    def __getattr__(self, name: str) -> Column:
        return self[name]

    def __getitem__(self, name: str) -> Column:
        if name not in self._values:
            from ..errors import ParameterError

            raise ParameterError(f"no value for parameter :{name}")
        return F.lit(self._values[name])
