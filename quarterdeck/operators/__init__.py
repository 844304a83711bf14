"""Operators over whole DataFrames: spines, joins, roll-ups, windows, filling, models, metrics."""
