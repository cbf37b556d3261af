"""Mergers, key helpers and the key filter."""
