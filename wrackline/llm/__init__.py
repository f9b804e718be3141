"""Operators for large text collections used in training and evaluation.

Nothing outside this package imports it; it may use the rest of the library.
"""
