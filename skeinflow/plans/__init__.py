"""Queries: operators bound to the columns of given tables."""
