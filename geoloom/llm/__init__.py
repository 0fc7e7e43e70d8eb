"""Operators on text corpora for language models. Nothing outside this package imports it."""
