"""Delimited text tables and prediction files."""
