"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings`` tables.

Nothing outside this subpackage imports it; its queries are in :mod:`stratalog.llm.queries`.
"""
