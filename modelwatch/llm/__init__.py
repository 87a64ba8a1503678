"""Operators for preparing training text: scoring, deduplication, tokenising, decontamination.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
