"""Pipelines: fitted steps in a row, applied, inverted and stored."""
