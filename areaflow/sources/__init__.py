"""Readers, sinks and staged tables."""
