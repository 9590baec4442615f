"""Stores: rows, DataFrames, Parquet folders and catalog tables, with keys."""
