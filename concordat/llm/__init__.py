"""Operators for building language-model training corpora.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and the entry module
pick it up, and the rest of the library works without it.
"""
