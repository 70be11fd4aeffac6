"""Identifiers of papers, repositories and benchmark results.

The helpers name a column once or twice only; callers put each step in a column of its own, which keeps the
plan small and every regular expression evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, col, drop_prefix, drop_suffix, strip_chars, text_or_empty
from .urls import split_url

# Patterns and clean-up characters of the identifiers.
ARXIV_LINK = r"(?i)arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)"
ARXIV_ID = r"(?i)([0-9]{4}\.[0-9]{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)"
DOI_TEXT = r"(?i)(?:doi\.org/|doi:\s*)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
REPOSITORY_TEXT = r"(?i)(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
EDGE_CHARS = " .;,"


def clean_arxiv_id(c: Column | str) -> Column:
    """First id-shaped part, else the trimmed text."""
    text = drop_suffix(drop_prefix(F.trim(col(c)), "arXiv:", "arxiv:"), ".pdf")
    return F.coalesce(blank_to_null(F.regexp_extract(text, ARXIV_ID, 1)), strip_chars(text, EDGE_CHARS))


def arxiv_id_in_link(link: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(link), ARXIV_LINK, 1)


def clean_doi(c: Column | str) -> Column:
    text = drop_prefix(F.trim(col(c)), "doi:", "https://doi.org/")
    return F.lower(strip_chars(text, EDGE_CHARS))


def doi_in_text(link: Column | str, summary: Column | str) -> Column:
    return F.regexp_extract(F.concat_ws(" ", text_or_empty(link), text_or_empty(summary)), DOI_TEXT, 1)


def repository_in_text(*columns: Column | str) -> Column:
    """``github.com/owner/name`` found anywhere in the columns, else the empty string."""
    found = F.regexp_extract(F.concat_ws(" ", *[text_or_empty(c) for c in columns]), REPOSITORY_TEXT, 0)
    return F.regexp_replace(found, r"(?i)^.*?github\.com/", "github.com/")


def trimmed_repository(c: Column | str) -> Column:
    """Text without quotes, closing punctuation and ``.git``."""
    text = strip_chars(F.trim(col(c)), "`'\" ")
    return drop_suffix(F.regexp_replace(text, r"[).,;]+$", ""), ".git")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def shortened_repository(c: Column | str) -> Column:
    """``host/owner/name`` when a trimmed text has all three, else the text."""
    text = col(c)
    parts = split_url(F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text)))
    names = path_parts(parts.path)
    name = drop_suffix(F.get(names, F.lit(1)), ".git")
    # Concatenation is NULL when a part is.
    whole = F.concat(
        blank_to_null(F.lower(parts.authority)), F.lit("/"), F.get(names, F.lit(0)), F.lit("/"), name
    )
    return F.coalesce(whole, text)


def repository_url(c: Column | str) -> Column:
    """Address of a repository text: ``owner/name`` is taken to be on GitHub."""
    text = F.trim(col(c))
    is_bare = text.contains("/") & ~text.rlike("^https?://")
    has_host = F.substring_index(text, "/", 1).contains(".")
    return (
        F.when(is_bare & has_host, F.concat(F.lit("https://"), text))
        .when(is_bare, F.concat(F.lit("https://github.com/"), text))
        .otherwise(text)
    )


def first_number(c: Column | str) -> Column:
    """First group of digits, with commas between them removed."""
    digits = F.regexp_extract(col(c), r"(\d[\d,]*)", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("bigint")
