"""Operators for training-data work on text tables; nothing else in the library imports this package."""
