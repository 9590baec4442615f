"""Functions that statements may call besides Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError

#: Aggregates by name: from argument Columns to a Column. The sum of no values is 0.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "avg": F.avg,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
}
#: Scalar functions by name that stand for SQL text; {0}, {1}, ... are the arguments.
MACROS: dict[str, str] = {
    "cmp": "(CASE WHEN ({0}) < ({1}) THEN -1 WHEN ({0}) > ({1}) THEN 1 WHEN ({0}) = ({1}) THEN 0 END)",
    # neither null, false, zero, NaN nor an empty string
    "truthy": "coalesce(CASE WHEN typeof({0}) = 'string' THEN cast(({0}) AS string) <> '' ELSE NOT cast(({0}) AS string) RLIKE '^(false|NaN|-?0([.]0+)?)$' END, false)",
    # whether an outer join found nothing for an alias
    "missing": "(({0}.__present) IS NULL)",
    # halves are rounded up, not away from zero
    "round_half_up": "cast(floor(({0}) + 0.5D) AS bigint)",
}
#: Python functions to register with the session that runs a statement.
UDFS: dict[str, object] = {}


def register(name: str, function: object) -> None:
    """function: SQL text with {0}, {1}, ... for its arguments, or a (pandas) UDF of pyspark."""
    name = name.lower()
    if name in AGGREGATES:
        raise QueryError(f"{name} is an aggregate")
    if isinstance(function, str):
        MACROS[name] = function
    elif hasattr(function, "returnType") or hasattr(function, "func"):
        UDFS[name] = function
    else:
        raise QueryError(f"{name}: SQL text or a UDF is needed")


def register_aggregate(name: str, function: Callable[..., Column]) -> None:
    """function: from argument Columns to an aggregate Column (grouped-aggregate pandas UDFs are such functions)."""
    AGGREGATES[name.lower()] = function


def install(spark: SparkSession) -> None:
    for name, f in UDFS.items():
        spark.udf.register(name, f)
