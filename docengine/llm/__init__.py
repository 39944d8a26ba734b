"""Operators for preparing language-model training data. Nothing else in docengine imports this subpackage."""
