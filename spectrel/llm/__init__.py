"""Operators for large text and vector corpora, one module each."""
