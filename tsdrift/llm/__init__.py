"""Operators for preparing language-model training data, keyed by document."""
