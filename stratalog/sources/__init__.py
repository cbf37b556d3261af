"""Logs over tables, batches, and the store on immutable Parquet segments."""
