"""Operators for training-data preparation; nothing else in the library depends on them."""
