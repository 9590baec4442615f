"""Fluent relational queries on Spark: build a statement, run it as a DataFrame."""

from .errors import QueryError
from .functions import expr, register, register_aggregate
from .plans.query import Query, delete_from, insert, release, select, update, upsert
from .plans.transaction import Transaction, transaction
from .sources.ranges import Range
from .sources.store import Store

__all__ = [
    "Query", "QueryError", "Range", "Store", "Transaction", "delete_from", "expr", "insert", "register", "register_aggregate",
    "release", "select", "transaction", "update", "upsert",
]
