"""Texts and files that results are written to."""
