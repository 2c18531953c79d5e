"""Corpus operators as DataFrame transformations."""
