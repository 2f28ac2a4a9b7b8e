"""Operators that a large training-data pipeline needs, over `documents`, `embeddings` and `conversations`.

Nothing else in the library imports this subpackage.
"""
