"""Operators for training data; optional: nothing outside this package imports it."""
