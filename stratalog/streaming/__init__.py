"""Ingest of streams into a store."""
