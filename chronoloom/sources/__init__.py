"""Readers for time-series file formats."""
