"""Readers, writers and staged tables."""
