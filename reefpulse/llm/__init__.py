"""Operators for preparing training text: deduplication, filters, extraction, mixing.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
