"""Operators that prepare text and record collections for training. Nothing outside this package imports it."""
