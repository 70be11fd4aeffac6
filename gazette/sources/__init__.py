"""Readers, writers and feed normalisers."""
