"""Readers: Parquet tables, repository trees, git state and snapshots."""
