"""Whole runs: discovery of links and keys, kept up to date."""
