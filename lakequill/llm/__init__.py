"""Operators for training-data preparation. Nothing else in the library imports this subpackage."""
