"""Errors of building and running statements; all are QueryErrors."""


class QueryError(Exception):
    """A statement can't be built or run as asked."""


class AliasError(QueryError):
    """An alias clashes, is unknown or is reserved."""


class AggregateError(QueryError):
    """An aggregate where none is allowed, or without argument."""


class ParameterError(QueryError):
    """A parameter without value."""


class KeyError_(QueryError):
    """A row without primary key, or a key twice."""


class TransactionError(QueryError):
    """A transaction that has ended, or can't hold a store."""
