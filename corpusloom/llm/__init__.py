"""Operators for training-data pipelines: deduplication, classifiers, mixing, tokenisation.

Nothing outside this folder imports it.
"""
