"""Operators for training corpora over documents, pages and embeddings. Nothing else in the library imports this package."""
