"""Corpus operators for training data: one module for each, `queries` registers them.

Nothing outside this subpackage (and `corpus_pipeline.py`) imports it.
"""
