"""Operators for training-data pipelines: quality, near duplicates, packing, formats, scans.

Nothing outside this subpackage imports it; the queries are in :mod:`tracelake.llm.queries`.
"""
