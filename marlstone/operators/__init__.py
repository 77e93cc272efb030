"""Joins, aggregates, windows, graph and budget operators."""
