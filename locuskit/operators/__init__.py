"""Operators on DataFrames: range joins, islands, components, assignment, id allocation."""
