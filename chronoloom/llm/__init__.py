"""Operators for preparing training corpora: deduplication, decontamination, filtering, sharding and packing.

Nothing outside this subpackage imports it.
"""
