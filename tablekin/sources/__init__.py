"""Readers of files, schema documents and databases."""
