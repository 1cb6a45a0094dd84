"""Operators for preparing language-model training data, on DataFrames of documents, pages and vectors."""
