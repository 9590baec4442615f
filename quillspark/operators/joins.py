"""Joins. Predicates are declared; Spark picks the strategy, pushes filters down and turns equalities of WHERE over a
cross join into join keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AliasError
from ..functions.text import Expr, bind, chains, conjuncts, tokens
from .scope import Scope

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "anti": "left_anti"}


def merge(left: Scope, right: Scope) -> dict[str, list[str]]:
    clash = set(left.aliases) & set(right.aliases)
    if clash:
        raise AliasError(f"alias used twice: {', '.join(sorted(clash))}")
    return {**left.aliases, **right.aliases}


def cross(left: Scope, right: Scope) -> Scope:
    return Scope(left.df.crossJoin(right.df), merge(left, right), left.outer)


def lateral(left: Scope, rows: Scope, alias: str, items: list, kind: str, on: list, params: dict) -> Scope:
    """A sub-query, which reads the left side's columns, for each row of that: its rows before it selects its items, which
    are named. Spark decorrelates it to a join. Items that read the left side are worked out above that join: within it,
    Spark would first cross the sub-query's rows with all the values that such items read."""
    if kind not in ("inner", "left"):
        raise AliasError(f"a sub-query that reads {', '.join(sorted(rows.outer))} can't be on the side of a {kind} join")
    names = [n for n, _ in items]
    aliases = merge(left, Scope(rows.df, {alias: names}))
    late = {i for i, (_, e) in enumerate(items) if isinstance(e, Expr) and rows.reads_outer(bind(e, params))}
    if late and kind == "left" and on:
        inside = within(left, rows, alias, dict(items), on, params)
        if inside is None:
            late = set()
        else:
            rows, on = filtered(rows, [rows.parsed(t) for t in inside], params), []
    if not late:
        right = rows.df.select(*[rows.column(e, params).alias(n) for n, e in items]).alias(alias)
        terms = [Scope(left.df, aliases, left.outer).column(e, params) for e in on]
        return Scope(left.df.lateralJoin(right, reduce(Column.__and__, terms) if terms else None, kind), aliases, left.outer)
    columns = [(a, c) for a, cs in rows.aliases.items() for c in cs]
    held = {f"__{i}": F.col(f"`{a}`.`{c}`") for i, (a, c) in enumerate(columns)}
    held |= {f"__v{i}": rows.column(e, params) for i, (_, e) in enumerate(items) if i not in late} | {"__found": F.lit(True)}
    joined = left.df.lateralJoin(rows.df.select(*[c.alias(k) for k, c in held.items()]).alias(f"__of_{alias}"), None, kind)
    # one row of the sub-query as a relation: names are looked up in it first, then on the left; Spark makes this a projection
    shown = [*zip(held, held, strict=True), *((f"__{i}", c) for i, (_, c) in enumerate(columns))]
    one = joined.sparkSession.sql("SELECT 1").select(*[F.col(f"`__of_{alias}`.`{k}`").outer().alias(n) for k, n in shown]).alias("__row")
    row = Scope(one, {"__row": [n for _, n in shown]}, rows.outer)
    at = {(a, c.lower()): f"`__row`.`__{i}`" for i, (a, c) in enumerate(columns)}
    values = [F.col(f"`__row`.`__v{i}`") if i not in late else row.parsed(rows.rows_as_structs(bind(e, params), at)) for i, (_, e) in enumerate(items)]
    if kind == "left":  # what found nothing is null
        values = [F.when(F.col("`__row`.`__found`"), v) for v in values]
    df = joined.lateralJoin(one.select(*[v.alias(n) for n, v in zip(names, values, strict=True)]).alias(alias), None, "inner")
    return filtered(Scope(df, aliases, left.outer), on, params)


def within(left: Scope, rows: Scope, alias: str, items: dict, on: list, params: dict) -> list[str] | None:
    """Bound ON terms of a lateral sub-query as terms of its own WHERE, items put in for their names; none if a term may then
    mean another column."""
    bare = {x.lower() for s in (left, rows) for a, cs in s.aliases.items() for x in (a, *cs)} | {x.lower() for x in (alias, *items)}
    out = []
    for e in on:
        if not isinstance(e, Expr):
            return None
        toks, text, at = tokens(bind(e, params)), [], 0
        for i, j, names in chains(toks):
            if len(names) > 1 and names[0] == alias:
                if not isinstance(item := items.get(names[1]), Expr):
                    return None
                text += [*toks[at:i], "(", bind(item, params), ")"]
                at = i + 3
            elif names[0].lower() in bare and not (len(names) > 1 and names[0] in left.aliases and names[0] not in rows.aliases):
                return None
        out.append("".join([*text, *toks[at:]]))
    return out


def join(left: Scope, right: Scope, kind: str, on: list, params: dict) -> Scope:
    both = Scope(left.df, merge(left, right), left.outer)
    later = []
    if left.outer:  # Spark takes references to outer rows in filters, not in conditions
        parts = split(on, params)
        later = [e for e in parts if isinstance(e, Expr) and both.reads_outer(e.text)]
        on = [e for e in parts if e not in later]
        if later and kind != "inner":
            raise AliasError(f"within a lateral sub-query, ON of a {kind} join can't read {', '.join(sorted(left.outer))}")
    terms = [both.column(e, params) for e in on]
    if kind == "inner" and not terms:
        return filtered(cross(left, right), later, params)
    condition = reduce(Column.__and__, terms) if terms else F.lit(True)
    df = left.df.join(right.df, condition, KINDS[kind])
    if kind == "anti":
        # the right side stays addressable: its columns are null
        df = df.join(right.df.filter(F.lit(False)), F.lit(False), "left")
    return filtered(Scope(df, both.aliases, left.outer), later, params)


def filtered(scope: Scope, terms: list, params: dict) -> Scope:
    for e in terms:
        scope = Scope(scope.df.filter(scope.column(e, params)), scope.aliases, scope.outer)
    return scope


def aliases_in(text: str, scope: Scope) -> set[str]:
    """Aliases that a predicate reads; a bare column counts for each alias that has it."""
    out = set()
    for _, _, names in chains(tokens(text)):
        if names[0] in scope.aliases:
            out.add(names[0])
        else:
            out |= {a for a, cs in scope.aliases.items() if names[0] in cs}
    return out


def split(on: list, params: dict) -> list:
    """Conjuncts of the text predicates, each its own; others as they are."""
    return [Expr(t) for e in on for t in conjuncts(bind(e, params))] if all(isinstance(e, Expr) for e in on) else on


def is_range(text: str) -> bool:
    """Whether a term is a comparison that a key range can stand for."""
    found = {t for t in tokens(text)}
    return bool(found & {"=", "<", "<=", ">", ">="}) and not found & {"<>", "!=", "<=>"} and " or " not in text.lower()
