"""Subword tokenization of text corpora as PySpark DataFrame operators."""
