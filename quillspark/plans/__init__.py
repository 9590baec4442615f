"""Statements, their execution and transactions."""
