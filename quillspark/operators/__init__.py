"""Relational operators over DataFrames with aliases."""
