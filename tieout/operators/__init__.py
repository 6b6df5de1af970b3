"""Relational operators of the engine: each takes DataFrames and returns DataFrames."""
