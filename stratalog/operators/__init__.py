"""Reads, retention and the relational operators of a levelled store."""
