"""Writes: insert, upsert, update and delete over a store's DataFrame.

The rows to write are written to the shared folder once, before anything changes; checks, counts, RETURNING and the new
state read that. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import KeyError_, QueryError
from ..sources.scratch import stash
from ..sources.store import PK, Store


@dataclass
class Written:
    """A store's new state, the rows written or deleted, and the change: keys that leave (__k0, ...), rows that come, the next
    generated key."""

    state: DataFrame
    rows: DataFrame
    gone: DataFrame | None = None
    added: DataFrame | None = None
    next_key: int | None = None


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Numbers 0, 1, ... without gaps: a place within the partition plus the sizes of the partitions before it."""
    tagged = stash(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = tagged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    inside = F.col("__at") - F.shiftleft(part, 33)
    return tagged.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__before") + inside).drop("__at", "__part", "__before")


def _flat(store: Store, df: DataFrame) -> DataFrame:
    """df with its key as columns __k0, __k1, ..."""
    return df.withColumns({f"__k{i}": F.col(k) for i, k in enumerate(store.key)})


def _keys(store: Store) -> list[str]:
    return [f"__k{i}" for i in range(len(store.key))]


def _fill_keys(store: Store, state: DataFrame, rows: DataFrame, next_key: int | None) -> tuple[DataFrame, int | None]:
    """Rows without a key get the next numbers, if the store makes keys; and the number after all keys."""
    key = store.key[0]
    if key not in rows.columns and "." not in key:
        if not store.auto or len(store.key) > 1:
            raise KeyError_(f"{store.name}: rows have no primary key {key}")
        rows = rows.withColumn(key, F.lit(None).cast(state.schema[key].dataType))
    if not store.auto:
        return rows, None
    kind = state.schema[key].dataType
    seen = [rows] if next_key is not None else [state, rows]  # the next key is above those of the state already
    top = max((v for v in (df.agg(F.max(key)).first()[0] for df in seen) if v is not None), default=None)
    first = max(next_key or 0, 0 if top is None else int(top) + 1) if key == PK else max(next_key or 1, 1 if top is None else int(top) + 1)
    bare = rows.filter(F.col(key).isNull())
    n = bare.count()
    if not n:
        return rows, first
    new = numbered(bare.drop(key), "__number").withColumn(key, (F.col("__number") + first).cast(kind)).drop("__number")
    return rows.filter(F.col(key).isNotNull()).unionByName(new), first + n


def _conform(store: Store, state: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that the store knows get its types; new ones are added."""
    kinds = {f.name: f.dataType for f in state.schema}
    return rows.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in rows.columns])


def _near(store: Store, state: DataFrame, flat: DataFrame) -> DataFrame:
    """The state's rows between the least and the greatest of the new keys: files sorted by key can skip the others."""
    if len(store.key) > 1 or "." in store.key[0]:
        return state
    low, high = flat.agg(F.min("__k0"), F.max("__k0")).first()
    return state if low is None else state.filter(F.col(store.key[0]).between(F.lit(low), F.lit(high)))


def put(store: Store, state: DataFrame, rows: DataFrame, overwrite: bool, next_key: int | None = None) -> Written:
    rows, next_key = _fill_keys(store, state, stash(_conform(store, state, rows), "rows"), next_key)
    rows = stash(rows, "rows")
    flat = _flat(store, rows)
    keys = _keys(store)
    null = flat.filter(" OR ".join(f"{k} IS NULL" for k in keys))
    if not null.isEmpty():
        raise KeyError_(f"{store.name}: a row without primary key")
    if not flat.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise KeyError_(f"{store.name}: rows with the same primary key")
    gone = None
    if overwrite:
        gone = flat.select(*keys)
        state = _flat(store, state).join(gone, keys, "left_anti").drop(*keys)
    elif not _flat(store, _near(store, state, flat)).join(flat.select(*keys), keys, "left_semi").isEmpty():
        raise KeyError_(f"{store.name}: duplicate primary key")
    return Written(state.unionByName(rows, allowMissingColumns=True), rows, gone, rows, next_key)


def update(store: Store, state: DataFrame, matched: DataFrame, patch: list[str]) -> Written:
    """matched: the store's key as __k0, ... and new values __p0, ... of the patched columns, a row for each match."""
    for name in patch:
        if name in store.key or any(k.startswith(f"{name}.") for k in store.key):
            raise QueryError(f"{store.name}: an update can't change the key")
    keys = _keys(store)
    matched = stash(matched, "matched")
    if not matched.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise QueryError(f"{store.name}: several rows match one row of the store")
    kinds = {f.name: f.dataType for f in state.schema}
    all_ = _flat(store, state).join(matched.withColumn("__hit", F.lit(True)), keys, "left")

    def value(c: str) -> Column:
        if c not in patch:
            return F.col(f"`{c}`")
        new = F.col(f"__p{patch.index(c)}")
        if c not in kinds:
            return F.when(F.col("__hit"), new).alias(c)
        return F.when(F.col("__hit"), new.cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c)

    columns = [*state.columns, *[p for p in patch if p not in kinds]]
    new = all_.select(*[value(c) for c in columns], "__hit")
    rows = stash(new.filter("__hit").drop("__hit"), "updated")
    return Written(new.drop("__hit"), rows, _flat(store, rows).select(*keys), rows)


def update_where(store: Store, state: DataFrame, where: Column, values: dict[str, Column]) -> Written:
    """An update that reads the store's rows alone needs no join."""
    for name in values:
        if name in store.key or any(k.startswith(f"{name}.") for k in store.key):
            raise QueryError(f"{store.name}: an update can't change the key")
    kinds = {f.name: f.dataType for f in state.schema}
    hit = F.coalesce(where, F.lit(False))
    base = state.alias("this")
    columns = [values[c].cast(kinds[c]).alias(c) if c in values else F.col(f"this.`{c}`") for c in state.columns]
    columns += [v.alias(c) for c, v in values.items() if c not in kinds]
    rows = stash(base.filter(hit).select(*columns), "updated")
    kept = base.filter(~hit).select(*[F.col(f"this.`{c}`") for c in state.columns])
    return Written(kept.unionByName(rows, allowMissingColumns=True), rows, _flat(store, rows).select(*_keys(store)), rows)


def delete_where(store: Store, state: DataFrame, where: Column | None) -> Written:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    base = state.alias("this")
    rows = stash(base.filter(hit).select("this.*"), "deleted")
    return Written(base.filter(~hit).select("this.*"), rows, _flat(store, rows).select(*_keys(store)))


def delete_keys(store: Store, state: DataFrame, matched: DataFrame) -> Written:
    """matched: keys as __k0, ... of the rows to delete; a row that matches several times is deleted once."""
    keys = _keys(store)
    matched = stash(matched.select(*keys).distinct(), "matched")
    flat = _flat(store, state)
    return Written(flat.join(matched, keys, "left_anti").drop(*keys), flat.join(matched, keys, "left_semi").drop(*keys), matched)
