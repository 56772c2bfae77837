"""Structured-text search and analytics on PySpark DataFrames."""
