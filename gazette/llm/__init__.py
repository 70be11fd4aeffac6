"""Operators for preparing training corpora; nothing else of the library imports this package."""
