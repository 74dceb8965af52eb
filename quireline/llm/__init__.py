"""Training-data operators: filters, scoring, search, deduplication and mixing.

Nothing outside this folder imports it; it can be deleted without touching the
rest of the library.
"""
