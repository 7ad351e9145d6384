"""Operators for training-data work with language-model corpora.

Nothing outside this subpackage imports it.
"""
