"""Training-data operators: extraction, sanitising, deduplication, scoring, mixing, encoding.

Nothing else in the library imports this subpackage.
"""
