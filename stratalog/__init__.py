"""Versioned key-value change logs as DataFrames."""
