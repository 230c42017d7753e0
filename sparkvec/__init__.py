"""Filtered vector search and related table operators on PySpark DataFrames."""
