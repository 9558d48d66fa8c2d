"""Syntax checking of source files by generalised LL parsing."""
