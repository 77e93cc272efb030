"""Codebase and corpus analytics on Spark DataFrames."""
