"""Operators on model output, names and document text; nothing outside this package imports it."""
