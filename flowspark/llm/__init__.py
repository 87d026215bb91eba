"""Operators for training-data pipelines over documents, vectors and web addresses.

Nothing else in the library imports this subpackage. Words are runs of characters other than
the space and U+0009 to U+000D everywhere, and A-Z alone are lower-cased.
"""
