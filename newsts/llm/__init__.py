"""Operators of a training-data pipeline (one module per operator) and their
queries.  Nothing outside this package imports it."""
