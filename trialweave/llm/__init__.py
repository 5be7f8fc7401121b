"""Operators for large text corpora: deduplication, archives, tokenizers, classifiers, mixing and search.

Nothing else in the package imports this subpackage.
"""
