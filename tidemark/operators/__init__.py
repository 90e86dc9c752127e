"""Operators on price panels: each takes and returns DataFrames."""
