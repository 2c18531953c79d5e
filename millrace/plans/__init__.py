"""Composed queries, reports and command lines."""
