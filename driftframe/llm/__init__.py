"""Operators for preparing training data: ten operators over documents, pages and vectors."""
