"""Corpus-preparation operators for language-model training data.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames, names its columns by parameter, and picks only the columns it
needs on entry, so further columns of the input can't clash with its own.
"""
