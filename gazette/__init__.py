"""Corpus analytics for feeds of documents, written as PySpark DataFrame jobs."""
