"""Registered queries: the operators applied to projections of the given tables, with their SQL."""
