"""Readers for landed data and the table writers (replace-by-key, upsert, delete)."""
