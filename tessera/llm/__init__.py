"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""
