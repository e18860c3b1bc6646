"""Operators: pure ``DataFrame -> DataFrame`` functions, no actions inside."""
