"""Operators for preparing training text: scoring, cleaning, deduplication, tokens.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
