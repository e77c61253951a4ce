"""Operators over DataFrames: nearest cells, extraction, means, tide states and parity."""
