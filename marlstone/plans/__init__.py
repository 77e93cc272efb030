"""Whole plans: query catalogue, repository scan, renderers."""
