"""Operators of a training-data pipeline, each with a general interface of its own."""
