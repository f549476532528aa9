"""Operators for preparing language-model training data. Nothing else in tessella imports this subpackage."""
