"""Lenient splitting of URLs into scheme, authority and path."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, text_or_empty

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


class UrlParts(NamedTuple):
    scheme: Column
    authority: Column
    path: Column


def split_url(c: Column | str) -> UrlParts:
    """Scheme (lower case), authority with port and case kept, and path without parameters."""
    url = F.regexp_replace(text_or_empty(col(c)), r"^[\x00-\x20]+|[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    rest = F.regexp_replace(url, _SCHEME, "")
    authority = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1)
    return UrlParts(scheme, authority, F.regexp_replace(path, r";[^/]*$", ""))


def is_valid_url(c: Column | str) -> Column:
    """Scheme and authority are both present."""
    parts = split_url(c)
    brackets = parts.authority.contains("[") == parts.authority.contains("]")
    return (parts.scheme != "") & (parts.authority != "") & brackets
