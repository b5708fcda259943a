"""Relational and resampling operators: each takes and returns DataFrames."""
