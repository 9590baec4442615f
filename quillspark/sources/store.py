"""Stores: keyed tables that statements read and write.

A store's state is a DataFrame; writes replace it. Rows are found by key: columns of the row, dotted paths into structs,
or the hidden column _pk (numbers for rows given as a list, names for rows given as a dict). Generated keys are never given
twice: the next one is part of the state. Parquet stores keep snapshots (see there); a store that was read before another
writer's commit must be read anew (`refresh`) before it can commit.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .scratch import stash
from .snapshots import Change, Log, Snapshot, commit_all

PK, PRESENT = "_pk", "__present"
HIDDEN = (PK, PRESENT)
_numbers = itertools.count()


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def infer(rows: Sequence[Mapping]) -> T.StructType:
    """One type a column, over all rows; missing fields are null. Integers and floats make a double."""
    kinds: dict[str, list] = {}
    for r in rows:
        for k, v in r.items():
            kinds.setdefault(k, [])
            if v is not None:
                kinds[k].append(v)
    fields = []
    for name, values in kinds.items():
        types = {type(v) for v in values}
        if types == {int, float}:
            values = [float(v) for v in values]
        elif len(types) > 1:
            raise QueryError(f"column {name} mixes {', '.join(sorted(t.__name__ for t in types))}")
        if not values:
            fields.append(T.StructField(name, T.StringType()))
        elif isinstance(values[0], Mapping):
            fields.append(T.StructField(name, infer(values)))
        elif isinstance(values[0], (list, tuple)):
            inner = infer([{"x": v} for vs in values for v in vs] or [{"x": None}])
            fields.append(T.StructField(name, T.ArrayType(inner["x"].dataType)))
        else:
            fields.append(T.StructField(name, T._infer_type(values[0])))
    return T.StructType(fields)


def _fit(v, kind):
    """A value as createDataFrame takes it for a type."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_fit(v.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_fit(x, kind.elementType) for x in v]
    return float(v) if isinstance(kind, T.DoubleType) else v


class Store:
    def __init__(self, df: DataFrame, key: str | Sequence[str] | None = None, auto: bool = False, name: str | None = None, log: Log | None = None, base: Snapshot | None = None):
        self._df = df
        self.key = [PK] if key is None else [key] if isinstance(key, str) else list(key)
        self.auto = auto or key is None
        self.name = name or f"store{next(_numbers)}"
        self.log, self._base = log, base
        self.next_key = base.next_key if base else None
        self.database = df.sparkSession

    @classmethod
    def rows(cls, rows, key=None, schema: T.StructType | str | None = None, auto: bool = False, name: str | None = None) -> Store:
        """A list of dicts (hidden keys 0, 1, ...) or a dict of dicts (hidden keys are its names). Empty slots of a list
        (None) are skipped and keep their number."""
        spark = session()
        named = isinstance(rows, Mapping)
        pairs = [(k, r) for k, r in (rows.items() if named else enumerate(rows)) if r is not None]
        pairs = [(k, r if isinstance(r, Mapping) else {"value": r}) for k, r in pairs]
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema or infer([r for _, r in pairs])
        unknown = {c for _, r in pairs for c in r} - set(kind.names)
        if unknown:
            raise QueryError(f"rows have columns that the schema lacks: {', '.join(sorted(unknown))}")
        data = [_fit(r, kind) for _, r in pairs]
        if key is not None:
            return cls(spark.createDataFrame(data, kind), key, auto, name)
        full = T.StructType([*kind.fields, T.StructField(PK, T.StringType() if named else T.LongType())])
        out = cls(spark.createDataFrame([(*d, k) for d, (k, _) in zip(data, pairs, strict=True)], full), None, not named, name)
        out.auto = not named
        out.next_key = None if named else len(rows)
        return out

    @classmethod
    def dataframe(cls, df: DataFrame, key=None, auto: bool = False, name: str | None = None) -> Store:
        return cls(df, key, auto, name)

    @classmethod
    def table(cls, name: str, key=None, auto: bool = False) -> Store:
        return cls(session().table(name), key, auto, name)

    @classmethod
    def parquet(cls, path: str, key=None, auto: bool = False, name: str | None = None) -> Store:
        """A folder of Parquet files; what this class writes stands beside it, in <path>.snapshots."""
        log = Log(session(), path)
        base = log.current()
        return cls(log.read(base), key, auto, name, log, base)

    def refresh(self) -> Store:
        """Reads a Parquet store's last version."""
        if self.log:
            self._base = self.log.current()
            self._df, self.next_key = self.log.read(self._base), self._base.next_key
        return self

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions of a Parquet store before the last `keep`, and their files."""
        return self.log.vacuum(keep) if self.log else 0

    @property
    def df(self) -> DataFrame:
        return self._df

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c not in HIDDEN]

    def key_columns(self, alias: str | None = None) -> list[Column]:
        return [F.col(f"{alias}.{k}" if alias else k) for k in self.key]


def commit(held: Mapping[Store, tuple[DataFrame, Change]]) -> None:
    """New states and changes of stores: all are written before any counts; Parquet stores are made to count at once."""
    plain = [s for s in held if s.log is None]
    states = {s: stash(held[s][0], s.name) for s in plain}
    logged = [s for s in held if s.log is not None]
    for store, base in zip(logged, commit_all([(s.log, s._base, s.key, held[s][1]) for s in logged]), strict=True):
        store._base, store._df = base, store.log.read(base)
        store.next_key = base.next_key
    for store in plain:
        store._df, store.next_key = states[store], held[store][1].next_key
