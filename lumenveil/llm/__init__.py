"""Operators for large text and code collections; nothing outside this package imports it."""
