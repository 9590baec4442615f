"""The expression language: Spark SQL text or Columns, with parameters, literals, macros and registered functions."""

from .registry import register, register_aggregate
from .text import Expr, expr

__all__ = ["Expr", "expr", "register", "register_aggregate"]
