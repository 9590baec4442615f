"""The builder: an immutable list of clauses, run as DataFrames.

Order of evaluation: FROM and joins, WHERE, GROUP BY with its selector, HAVING, ORDER BY, SELECT; a union closes what is
before it, and clauses after it see its columns.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import AliasError, QueryError
from ..functions import registry
from ..functions.text import Expr, as_expr, chains, forbid_aggregates, tokens
from ..operators import joins, sets, writing
from ..operators.grouping import Grouping
from ..operators.scope import Scope
from ..operators.sorting import SortKey
from ..sources.store import PK, PRESENT, Store, session
from .transaction import Transaction


@dataclass
class Context:
    """One execution: parameters, memoized sub-queries, transaction."""

    params: dict
    txn: Transaction | None
    memo: dict[int, DataFrame] = field(default_factory=dict)
    uses: dict[int, int] = field(default_factory=dict)


def _items(args: tuple, named: dict) -> tuple:
    """Selector items as (name or None, expression)."""
    out: list = []
    if args and isinstance(args[0], str) and len(args) > 1 and "?" in args[0]:
        args = (Expr(args[0], args[1:]),)
    for a in args:
        if isinstance(a, Mapping):
            out += [(k, as_expr(v)) for k, v in a.items()]
        else:
            out.append((None, as_expr(a)))
    return tuple([*out, *[(k, as_expr(v)) for k, v in named.items()]])


def _relation(r) -> Store | Query:
    if isinstance(r, (Store, Query)):
        return r
    if isinstance(r, DataFrame):
        return Store.dataframe(r)
    if isinstance(r, (list, tuple, dict)):
        return Store.rows(r)
    raise QueryError(f"no relation: {type(r).__name__}")


@dataclass(frozen=True)
class Query:
    kind: str = "select"
    clauses: tuple = ()
    target: Store | None = None
    back: tuple | None = None
    memoized: bool = False
    compat_pushdown: bool = False
    frozen: bool = False
    bound: tuple = ()

    # building

    def _change(self, **fields) -> Query:
        if self.frozen:
            raise QueryError("the statement is final")
        return replace(self, **fields)

    def _with(self, *clause) -> Query:
        return self._change(clauses=(*self.clauses, clause))

    def _has(self, *names: str) -> bool:
        return any(c[0] in names for c in self.clauses)

    def select(self, *args, **named) -> Query:
        """A selector; allowed again once group_by or a union has used the one before."""
        after = self.clauses
        for i, c in enumerate(self.clauses):
            if c[0] in ("group_by", "union"):
                after = self.clauses[i + 1 :]
        if any(c[0] == "select" for c in after):
            raise QueryError("select was called already")
        return self._with("select", _items(args, named))

    def _add_relations(self, clause: str, relations: dict, kind: str | None = None) -> Query:
        if not relations:
            raise QueryError(f"{clause} needs a relation")
        taken = {a for c in self.clauses if c[0] in ("from", "join") for a, _ in c[1]} | ({"this"} if self.target else set())
        out = []
        for alias, r in relations.items():
            if alias.startswith(("$$", "__")):
                raise AliasError(f"reserved alias {alias}")
            if alias in taken:
                raise AliasError(f"alias used twice: {alias}")
            taken.add(alias)
            out.append((alias, _relation(r)))
        return self._with(clause, tuple(out), *([kind, ()] if kind else []))

    def from_(self, relations: Mapping | None = None, **named) -> Query:
        if self._has("from"):
            raise QueryError("from_ was called already")
        return self._add_relations("from", {**(relations or {}), **named})

    def join(self, relations: Mapping | None = None, **named) -> Query:
        return self._add_relations("join", {**(relations or {}), **named}, "inner")

    def left_join(self, relations: Mapping | None = None, **named) -> Query:
        return self._add_relations("join", {**(relations or {}), **named}, "left")

    def right_join(self, relations: Mapping | None = None, **named) -> Query:
        return self._add_relations("join", {**(relations or {}), **named}, "right")

    def full_join(self, relations: Mapping | None = None, **named) -> Query:
        return self._add_relations("join", {**(relations or {}), **named}, "full")

    def anti_join(self, relations: Mapping | None = None, **named) -> Query:
        return self._add_relations("join", {**(relations or {}), **named}, "anti")

    def on(self, predicate, *values) -> Query:
        """Belongs to the last join; several are ANDed."""
        e = as_expr(predicate, values)
        forbid_aggregates(e)
        at = [i for i, c in enumerate(self.clauses) if c[0] == "join"]
        if not at:
            raise QueryError("on needs a join before it")
        _, relations, kind, on = self.clauses[at[-1]]
        clauses = list(self.clauses)
        clauses[at[-1]] = ("join", relations, kind, (*on, e))
        return self._change(clauses=tuple(clauses))

    def where(self, predicate, *values) -> Query:
        e = as_expr(predicate, values)
        forbid_aggregates(e)
        return self._with("where", e)

    def group_by(self, *keys) -> Query:
        """Uses the selector before it; a group may be grouped again after another selector."""
        last = max((i for i, c in enumerate(self.clauses) if c[0] in ("group_by", "union")), default=-1)
        if not any(c[0] == "select" for c in self.clauses[last + 1 :]):
            raise QueryError("group_by needs a selector before it")
        return self._with("group_by", tuple(as_expr(k) for k in keys))

    def order_by(self, key, *values) -> Query:
        e = as_expr(key, values)
        forbid_aggregates(e)
        return self._with("order_by", SortKey(e))

    def _last_key(self, change: Callable[[SortKey], SortKey]) -> Query:
        if not self.clauses or self.clauses[-1][0] != "order_by":
            raise QueryError("a direction needs order_by before it")
        return self._change(clauses=(*self.clauses[:-1], ("order_by", change(self.clauses[-1][1]))))

    def order(self, sign: int) -> Query:
        return self._last_key(lambda k: k.directed(sign))

    def nulls(self, sign: int) -> Query:
        return self._last_key(lambda k: k.placed(sign))

    @property
    def asc(self) -> Query:
        return self.order(1)

    @property
    def desc(self) -> Query:
        return self.order(-1)

    @property
    def nulls_first(self) -> Query:
        return self.nulls(-1)

    @property
    def nulls_last(self) -> Query:
        return self.nulls(1)

    def _set(self, kind: str, other) -> Query:
        other = _relation(other)
        if isinstance(other, Query) and other.kind != "select":
            raise QueryError("only queries can be united")
        return self._with("union", kind, other)

    def union(self, other) -> Query:
        return self._set("union", other)

    def union_all(self, other) -> Query:
        return self._set("union_all", other)

    @property
    def memoize(self) -> Query:
        """Evaluated once in an execution, however often it is used."""
        return self._change(memoized=True)

    def into(self, store: Store) -> Query:
        if self.target is not None:
            raise QueryError("into was called already")
        if self.kind == "select":
            raise QueryError("a select has no target")
        if not isinstance(store, Store):
            store = _relation(store)
        if not isinstance(store, Store):
            raise QueryError("a statement writes into a store")
        if any(a == "this" for c in self.clauses if c[0] in ("from", "join") for a, _ in c[1]):
            raise AliasError("alias used twice: this")
        return self._change(target=store)

    def returning(self, *args, **named) -> Query:
        if self.back is not None:
            raise QueryError("returning was called already")
        if self.kind == "select":
            raise QueryError("a select returns its rows")
        return self._change(back=_items(args, named))

    def compat(self) -> Query:
        """Places predicates of outer and anti joins as the older, non-ANSI rule has it: ON terms over the left side alone
        filter the left rows, and WHERE comparisons over the right side alone act within the join. A right join is a left join
        of its sides exchanged; in a full join ON terms over one side alone filter that side, and WHERE acts on the result."""
        return self._change(compat_pushdown=True)

    def finalize(self) -> Query:
        self._check()
        return replace(self, frozen=True)

    def partial(self, **params) -> Query:
        """The statement with some of its parameters given; an execution may still give others, or these anew."""
        return replace(self, bound=(*self.bound, *params.items()))

    def _check(self) -> None:
        if self.kind in ("insert", "upsert", "update", "delete") and self.target is None:
            raise QueryError(f"{self.kind} needs into")
        if self.kind != "delete" and not self._has("select"):
            raise QueryError("a statement needs a selector")
        if self.kind == "select" and not self._has("from"):
            raise QueryError("a select needs from_")
        for q in self._children():
            q._check()

    def _children(self) -> Iterator[Query]:
        for c in self.clauses:
            for r in [x for _, x in c[1]] if c[0] in ("from", "join") else [c[2]] if c[0] == "union" else []:
                if isinstance(r, Query):
                    yield r

    def tree(self) -> dict:
        """The statement as nested dicts."""
        show = lambda e: e.text if isinstance(e, Expr) else str(e)
        rel = lambda r: r.tree() if isinstance(r, Query) else {"store": r.name}
        out: list = []
        for c in self.clauses:
            if c[0] == "from":
                out.append({"from": {a: rel(r) for a, r in c[1]}})
            elif c[0] == "join":
                out.append({"join": c[2], "with": {a: rel(r) for a, r in c[1]}, "on": [show(e) for e in c[3]]})
            elif c[0] == "select":
                out.append({"select": {n or str(i): show(e) for i, (n, e) in enumerate(c[1])}})
            elif c[0] == "group_by":
                out.append({"group_by": [show(e) for e in c[1]]})
            elif c[0] == "order_by":
                out.append({"order_by": show(c[1].by), "descending": c[1].descending, "nulls_first": c[1].nulls_first})
            elif c[0] == "union":
                out.append({c[1]: rel(c[2])})
            else:
                out.append({c[0]: show(c[1])})
        top = {"kind": self.kind, "clauses": out, "memoize": self.memoized}
        return top | ({"into": self.target.name} if self.target else {}) | ({"returning": [show(e) for _, e in self.back]} if self.back else {})

    # running

    def __call__(self, params: Mapping | None = None, txn: Transaction | None = None, **named) -> DataFrame:
        self._check()
        ctx = Context({**dict(self.bound), **(params or {}), **named}, txn)
        self._count_uses(ctx)
        registry.install(session())
        if self.kind == "select":
            if txn is not None:
                txn.check()
            return self._memo_or_run(ctx)
        return self._write(ctx)

    to_df = __call__

    def relation(self, **params) -> DataFrame:
        return self(**params)

    def explain(self, mode: str = "formatted", **params) -> None:
        self(**params).explain(mode)

    def collect(self, params: Mapping | None = None, txn: Transaction | None = None, **named) -> list[Row]:
        return self(params, txn, **named).collect()

    def for_each(self, f: Callable[[Row], object], params: Mapping | None = None, **named) -> None:
        for row in self(params, **named).toLocalIterator():
            f(row)

    def _count_uses(self, ctx: Context) -> None:
        for q in self._children():
            ctx.uses[id(q)] = ctx.uses.get(id(q), 0) + 1
            if ctx.uses[id(q)] == 1 or not q.memoized:
                q._count_uses(ctx)

    def _memo_or_run(self, ctx: Context) -> DataFrame:
        if self.bound:  # a sub-query's own parameters, where the execution gives none
            ctx = replace(ctx, params={**dict(self.bound), **ctx.params})
        if not self.memoized:
            return self._run(ctx)
        if id(self) not in ctx.memo:
            df = self._run(ctx)
            if ctx.uses.get(id(self), 0) > 1:
                df = _keep(df.persist(StorageLevel.MEMORY_AND_DISK))
            ctx.memo[id(self)] = df
        return ctx.memo[id(self)]

    def _scan(self, alias: str, r: Store | Query, ctx: Context, mark: bool, outer: frozenset[str] = frozenset()) -> Scope:
        if isinstance(r, Query):
            if r.kind != "select":
                raise QueryError("only a query can be read from")
            df = r._memo_or_run(ctx)
        else:
            df = _visible(r, ctx)
        if mark:
            df = df.withColumn(PRESENT, F.lit(True))
        return Scope(df.alias(alias), {alias: df.columns}, outer)

    def _reads(self, aliases: set[str]) -> set[str]:
        """Which of these aliases, none of its own, the statement's expressions read."""
        own = {a for c in self.clauses if c[0] in ("from", "join") for a, _ in c[1]}
        texts = [e.text for e in _expressions(self.clauses) if isinstance(e, Expr)]
        return {names[0] for t in texts for _, _, names in chains(tokens(t)) if len(names) > 1} & aliases - own

    def _lateral(self, ctx: Context, outer: frozenset[str]) -> tuple[Scope, list]:
        """A sub-query that reads the columns of relations before it: rows of FROM, joins and WHERE, and a selector of names."""
        items = next(c[1] for c in self.clauses if c[0] == "select")
        names = [n or e.text.rsplit(".", 1)[-1] for n, e in items]
        if self._has("group_by", "union", "order_by") or not all(re.fullmatch(r"\w+", n) for n in names):
            raise AliasError("a sub-query that reads the relations before it has no groups, unions or order, and names its columns")
        scope, _ = self._rows(self.clauses, ctx, outer=outer)
        return scope, [(n, e) for n, (_, e) in zip(names, items, strict=True)]

    def _rows(self, clauses, ctx: Context, start: Scope | None = None, outer: frozenset[str] = frozenset()) -> tuple[Scope, list]:
        """FROM, joins and WHERE of the first segment, and the clauses that are left."""
        params = ctx.params
        marks = any("missing" in (e.text.lower() if isinstance(e, Expr) else "") for e in _expressions(clauses))
        # a bracketed list of relations is crossed first, then joined as one
        wheres = [c[1] for c in clauses if c[0] == "where"]
        scope = start
        for c in clauses:
            if c[0] not in ("from", "join"):
                continue
            side: Scope | None = None
            items: list | None = None
            for alias, r in c[1]:
                if isinstance(r, Query) and scope is not None and (seen := r._reads(set(scope.aliases))):
                    if side is not None or len(c[1]) > 1:
                        raise AliasError(f"a sub-query that reads {', '.join(sorted(seen))} must be a join's only relation")
                    one, items = r._lateral(ctx, frozenset(scope.aliases))
                else:
                    one = self._scan(alias, r, ctx, marks, outer)
                side = one if side is None else joins.cross(side, one)
            if scope is None:
                scope = side
            elif c[0] == "from":
                scope = joins.cross(scope, side)
            elif items is not None:
                scope = joins.lateral(scope, side, alias, items, c[2], list(c[3]), params)
            else:
                kind, on = c[2], list(c[3])
                if self.compat_pushdown and kind in ("left", "anti"):
                    scope, on, wheres = _older_rule(scope, side, on, wheres, params)
                elif self.compat_pushdown and kind == "right":  # a left join of the other side
                    side, on, wheres = _older_rule(side, scope, on, wheres, params)
                elif self.compat_pushdown and kind == "full":  # each side is the left one of a part; WHERE acts on the whole
                    scope, on, _ = _older_rule(scope, side, on, [], params)
                    side, on, _ = _older_rule(side, scope, on, [], params)
                scope = joins.join(scope, side, kind, on, params)
        if scope is None:
            raise QueryError("a statement needs from_")
        return joins.filtered(scope, wheres, params), [c for c in clauses if c[0] not in ("from", "join", "where")]

    def _run(self, ctx: Context) -> DataFrame:
        cut = next((i for i, c in enumerate(self.clauses) if c[0] in ("group_by", "union")), len(self.clauses))
        head, tail = self.clauses[:cut], self.clauses[cut:]
        scope, rest = self._rows(head, ctx)
        selector = next((c[1] for c in rest if c[0] == "select"), None)
        orders = [c[1] for c in rest if c[0] == "order_by"]

        def close() -> Scope:
            """ORDER BY before SELECT: keys may be columns that are not selected."""
            df = scope.df.orderBy(*[k.column(scope.column(k.by, ctx.params)) for k in orders]) if orders else scope.df
            if selector is None:
                return Scope(df) if not scope.aliases else Scope(Scope(df, scope.aliases).select([(None, Expr("*"))], ctx.params))
            return Scope(Scope(df, scope.aliases).select(selector, ctx.params))

        for c in tail:
            if c[0] == "group_by":
                scope = Grouping(scope, list(c[1]), ctx.params).run(selector)
                selector, orders = None, []
            elif c[0] == "where":
                scope = Scope(scope.df.filter(scope.column(c[1], ctx.params)))
            elif c[0] == "order_by":
                orders.append(c[1])
            elif c[0] == "select":
                selector = c[1]
            elif c[0] == "union":
                left = close().df.drop(PK)
                right = c[2]._memo_or_run(ctx) if isinstance(c[2], Query) else _visible(c[2], ctx).drop(PK)
                scope, selector, orders = Scope(sets.union(left, right, c[1] == "union")), None, []
            else:
                raise QueryError(f"{c[0]} can't follow group_by or a union")
        return close().df

    # writing

    def _write(self, ctx: Context) -> DataFrame:
        own = ctx.txn is None
        txn = ctx.txn = ctx.txn or Transaction()
        try:
            txn.check()
            store = self.target
            state = txn.df(store)
            done = self._written(store, state, ctx)
            result = self._result(done.rows, ctx)
            txn.put(store, done)
            if own:
                txn.commit()
        except Exception:
            if txn.state == "open":
                txn.abort()
            raise
        return result

    def _written(self, store: Store, state: DataFrame, ctx: Context) -> writing.Written:
        if self.kind in ("insert", "upsert"):
            query = self if self._has("from") else self._with("from", (("__one", Store.dataframe(session().range(1).drop("id"))),))
            rows = replace(query, kind="select", memoized=False)._run(ctx)
            return writing.put(store, state, rows, self.kind == "upsert", ctx.txn.next_key(store))
        this = Scope(state.alias("this"), {"this": state.columns})
        plain = not self._has("from", "join")
        if plain:
            wheres = [c[1] for c in self.clauses if c[0] == "where"]
            where = None
            for e in wheres:
                c = this.column(e, ctx.params)
                where = c if where is None else where & c
        else:
            scope, _ = self._rows([c for c in self.clauses if c[0] != "select"], ctx, this)
            keys = {f"__k{i}": F.col(f"this.{k}") for i, k in enumerate(store.key)}
        if self.kind == "delete":
            if plain:
                return writing.delete_where(store, state, where)
            return writing.delete_keys(store, state, scope.df.select(*[v.alias(k) for k, v in keys.items()]))
        items = next(c[1] for c in self.clauses if c[0] == "select")
        if any(n is None for n, _ in items):
            raise QueryError("an update names the columns it sets")
        if plain:
            return writing.update_where(store, state, F.lit(True) if where is None else where, {n: this.column(e, ctx.params) for n, e in items})
        values = [scope.column(e, ctx.params).alias(f"__p{i}") for i, (_, e) in enumerate(items)]
        matched = scope.df.select(*[v.alias(k) for k, v in keys.items()], *values)
        return writing.update(store, state, matched, [n for n, _ in items])

    def _result(self, rows: DataFrame, ctx: Context) -> DataFrame:
        if self.back is None:
            n = rows.count()
            return session().createDataFrame([(n,)], "count long")
        scope = Scope(rows.alias("this"), {"this": rows.columns})
        if len(self.back) == 1 and isinstance(self.back[0][1], Expr) and self.back[0][1].text.strip() == "*":
            return rows.drop(PK)
        return scope.select(self.back, ctx.params)


def _visible(store: Store, ctx: Context) -> DataFrame:
    """The store's rows as the transaction sees them."""
    return ctx.txn.df(store) if ctx.txn else store.df


#: Memoized results that stay persisted: whatever is built on a statement's result finds them, until so many others came.
MAX_KEPT = 64
_kept: deque[DataFrame] = deque()


def _keep(df: DataFrame) -> DataFrame:
    _kept.append(df)
    while len(_kept) > MAX_KEPT:
        _unpersist(_kept.popleft())
    return df


def release() -> None:
    """Drops all memoized results; frames that read them compute them anew."""
    while _kept:
        _unpersist(_kept.popleft())


def _unpersist(df: DataFrame) -> None:
    try:
        df.unpersist()
    except Exception:  # noqa: BLE001 - the session may be gone
        pass


def _expressions(clauses) -> Iterator[object]:
    for c in clauses:
        if c[0] == "where":
            yield c[1]
        elif c[0] == "join":
            yield from c[3]
        elif c[0] == "select":
            yield from (e for _, e in c[1])
        elif c[0] == "group_by":
            yield from c[1]
        elif c[0] == "order_by":
            yield c[1].by


def _older_rule(left: Scope, right: Scope, on: list, wheres: list, params: dict) -> tuple[Scope, list, list]:
    both = Scope(left.df, {**left.aliases, **right.aliases})
    kept = []
    for e in joins.split(on, params):
        if isinstance(e, Expr) and (read := joins.aliases_in(e.text, both)) and read <= set(left.aliases):
            left = Scope(left.df.filter(left.column(e, params)), left.aliases)
        else:
            kept.append(e)
    later = []
    for e in joins.split(wheres, params):
        if isinstance(e, Expr) and (read := joins.aliases_in(e.text, both)) and read <= set(right.aliases) and joins.is_range(e.text):
            kept.append(e)
        else:
            later.append(e)
    return left, kept, later


def select(*args, **named) -> Query:
    return Query().select(*args, **named)


def insert(*args, **named) -> Query:
    return Query("insert").select(*args, **named)


def upsert(*args, **named) -> Query:
    return Query("upsert").select(*args, **named)


def update(*args, **named) -> Query:
    return Query("update").select(*args, **named)


def delete_from(store: Store) -> Query:
    return Query("delete").into(store)


__all__ = ["Context", "Query", "delete_from", "insert", "release", "select", "update", "upsert"]
