"""Training-data operators: scoring, tokenizing, formatting, mixing, deduplication, search and storage.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries and SQL.
"""
