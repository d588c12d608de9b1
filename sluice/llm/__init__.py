"""Operators for preparing training data, one module each; see the README for the list."""
