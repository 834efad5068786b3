"""Operators on long tables: one row for each entity and step."""
