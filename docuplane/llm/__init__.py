"""Operators for model training data. Nothing outside this subpackage imports it."""
