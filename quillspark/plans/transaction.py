"""Transactions: stores' new states are held aside, seen by the transaction alone, and committed or dropped together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TransactionError
from ..operators.writing import Written
from ..sources.snapshots import Change
from ..sources.store import Store, commit


class Transaction:
    """`with transaction() as t:` commits at the end, or aborts if an error leaves the block."""

    def __init__(self):
        self.state = "open"
        self._held: dict[Store, tuple[DataFrame, Change]] = {}
        self._database = None

    def check(self) -> None:
        if self.state != "open":
            raise TransactionError(f"the transaction is {self.state}")

    def join(self, store: Store) -> None:
        """A transaction is of one database: one Spark session."""
        self.check()
        if self._database is not None and self._database is not store.database:
            raise TransactionError("stores of several sessions in one transaction")
        self._database = store.database

    def df(self, store: Store) -> DataFrame:
        self.join(store)
        return self._held[store][0] if store in self._held else store.df

    def next_key(self, store: Store) -> int | None:
        return self._held[store][1].next_key if store in self._held else store.next_key

    def put(self, store: Store, done: Written) -> None:
        """The store's new state, and what has changed since the transaction began."""
        change = self._held[store][1] if store in self._held else Change(next_key=store.next_key)
        gone, added = change.gone, change.added
        if done.gone is not None:
            gone = done.gone if gone is None else gone.unionByName(done.gone)
            if added is not None:
                keyed = added.withColumns({n: F.col(k) for k, n in zip(store.key, done.gone.columns, strict=True)})
                added = keyed.join(done.gone, done.gone.columns, "left_anti").select(added.columns)
        if done.added is not None:
            added = done.added if added is None else added.unionByName(done.added, allowMissingColumns=True)
        next_key = done.next_key if done.next_key is not None else change.next_key
        if next_key is None and store.auto and done.gone is not None:  # the keys that leave aren't given again
            top = self.df(store).agg(F.max(store.key[0])).first()[0]
            next_key = None if top is None else int(top) + 1
        self._held[store] = (done.state, Change(gone, added, next_key))

    def commit(self) -> None:
        """All states are written whole before any counts; a failure leaves all as they were."""
        self.check()
        try:
            commit(self._held)
        except Exception:
            self.state = "aborted"
            raise
        self.state = "committed"

    def abort(self) -> None:
        self.check()
        self.state = "aborted"
        self._held.clear()

    def __enter__(self) -> Transaction:
        self.check()
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self.state == "open":
            if kind is None:
                self.commit()
            else:
                self.abort()


def transaction() -> Transaction:
    return Transaction()
