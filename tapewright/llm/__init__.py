"""Operators for large training data; nothing outside this folder imports it."""
