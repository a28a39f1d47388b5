"""Operators for large training-text corpora. Nothing else in the package imports this one."""
