"""Operators for large text corpora: filtering, deduplication, tokenising, sharding and archiving.

Nothing else in the library imports this subpackage.
"""
