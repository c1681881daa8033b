"""Relational, key-value and map/reduce operators on DataFrames."""
