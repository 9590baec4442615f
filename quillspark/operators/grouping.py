"""GROUP BY: aggregate calls of the selector become aggregate columns, and the rest is computed from these and the keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AggregateError, QueryError
from ..functions.registry import AGGREGATES
from ..functions.text import Expr, bind, calls, chains, forbid_aggregates, tokens
from .scope import Scope


def _norm(toks: list[str]) -> list[str]:
    return [t.lower() if t[0] not in "'\"`" else t for t in toks if not t.isspace()]


class Grouping:
    def __init__(self, scope: Scope, keys: list, params: dict):
        self.scope, self.params = scope, params
        self.aggregates: list[Column] = []
        self.keys: list[Column] = []
        self.key_tokens: list[list[str]] = []
        for e in keys:
            forbid_aggregates(e)
            self.keys.append(scope.column(e, params).alias(f"__key_{len(self.keys)}"))
            self.key_tokens.append(_norm(tokens(bind(e, params))) if isinstance(e, Expr) else [])

    def _add(self, c: Column) -> str:
        self.aggregates.append(c.alias(f"__agg_{len(self.aggregates)}"))
        return f"__agg_{len(self.aggregates) - 1}"

    def rewrite(self, text: str) -> str:
        toks, out, at = tokens(text), [], 0
        for first, stop, name, args in calls(toks, AGGREGATES):
            if not args:
                raise AggregateError(f"{name} needs an argument")
            inner = []
            for a in args:
                for _ in calls(a, AGGREGATES):
                    raise AggregateError(f"an aggregate within {name}")
                arg = "".join(a).strip()
                self.scope.check(arg)
                inner.append(F.lit(1) if name == "count" and arg == "*" else F.expr(self.scope.rows_as_structs(arg)))
            out += toks[at:first]
            out.append(self._add(AGGREGATES[name](*inner)))
            at = stop
        toks = [*out, *toks[at:]]
        toks = self._put_keys(toks)
        # what is neither aggregated nor a key: the value of the last row of the group, in no defined order
        columns = {c.lower() for c in self.scope.df.columns}
        out, at = [], 0
        for i, j, names in chains(toks):
            head = names[0]
            if head.startswith(("__agg_", "__key_")):
                continue
            if head in self.scope.aliases or head.lower() in columns:
                out += toks[at:i]
                out.append(self._add(F.last(F.expr("".join(toks[i:j])), ignorenulls=False)))
                at = j
        return "".join([*out, *toks[at:]])

    def _put_keys(self, toks: list[str]) -> list[str]:
        for k, key in enumerate(self.key_tokens):
            if not key:
                continue
            dense = [i for i, t in enumerate(toks) if not t.isspace()]
            norm = [_norm([toks[i]])[0] for i in dense]
            i = 0
            while i + len(key) <= len(norm):
                before = norm[i - 1] if i else ""
                after = norm[i + len(key)] if i + len(key) < len(norm) else ""
                # `k` names the key `t.k` too
                if norm[i : i + len(key)] == key and before != "." and after not in (".", "("):
                    toks = [*toks[: dense[i]], f"__key_{k}", *toks[dense[i + len(key) - 1] + 1 :]]
                    dense = [j for j, t in enumerate(toks) if not t.isspace()]
                    norm = [_norm([toks[j]])[0] for j in dense]
                i += 1
        return toks

    def run(self, items) -> Scope:
        if not items:
            raise QueryError("group_by needs a selector before it")
        outputs: list[Column] = []
        for name, e in items:
            if isinstance(e, Expr):
                text = bind(e, self.params).strip()
                if text in self.scope.aliases:
                    raise AggregateError("a whole row is neither aggregated nor a key")
                plain = [n for i, j, n in chains(tokens(text)) if i == 0 and j == len(tokens(text))]
                default = plain[0][-1] if plain and len(items) > 1 else "value"
                outputs.append(F.expr(self.rewrite(text)).alias(name or default))
            else:
                c = e if isinstance(e, Column) else self.scope.column(e, self.params)
                outputs.append(F.col(self._add(c)).alias(name or "value"))
        keys = self.keys or [F.lit(1).alias("__key_0")]  # a constant key: no rows, no group
        grouped = self.scope.df.groupBy(*keys)
        df = grouped.agg(*self.aggregates) if self.aggregates else self.scope.df.select(*keys).distinct()
        return Scope(df.select(*outputs))
