"""Operators for preparing language-model training data.

Everything here is optional: no other part of the library imports this subpackage.
"""
