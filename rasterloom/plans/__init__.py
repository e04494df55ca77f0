"""Pipelines as data: parsing, validation, size flow, rewrites, and compilation to DataFrames."""
