"""Operators for preparing text, page and media tables for model training.

Nothing else in the library imports this subpackage.
"""
