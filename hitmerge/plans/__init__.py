"""Whole jobs: the search round, offline deduplication, evaluation, and the registered queries."""
