"""Operators on document texts. Nothing outside this subpackage imports it."""
