"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage.
"""
