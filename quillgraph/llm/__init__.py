"""Operators for large text corpora: deduplication, classifiers, mixing, tokens, privacy, search and language models.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames, names its columns by
parameter and leaves other columns alone, so that extra columns (even ones named like an operator's own) are harmless.
"""
