"""Operators for preparing language-model training data. Nothing else in the package imports this."""
