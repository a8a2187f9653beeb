"""Operators of discovery."""
