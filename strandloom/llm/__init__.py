"""Operators for large-scale text-corpus preparation. Nothing outside this subpackage imports it."""
