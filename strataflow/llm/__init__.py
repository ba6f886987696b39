"""Operators for preparing language-model training data. Nothing outside this folder imports it."""
