"""Operators for large text collections and record linkage; nothing else in the library imports this."""
