"""Operators on long tables keyed by phrase: every one takes and returns DataFrames."""
