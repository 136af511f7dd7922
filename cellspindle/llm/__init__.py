"""Operators for text and record corpora. Nothing outside this subpackage imports it."""
