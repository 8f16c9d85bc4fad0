"""Operators that prepare text and records for training language models. Nothing outside this package imports it."""
