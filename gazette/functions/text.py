"""Text columns: spaces, titles, slugs, digests, HTML character references."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character: letters, numbers and underscore of any script.
WORD = r"[\p{L}\p{N}_]"
# White space of any script, with the four separator control characters.
SPACE = r"(?U)[\s\x1c-\x1f]+"
# Any other character.
NO_SPACE = r"(?U)[^\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """First trimmed, non-blank value, else the empty string."""
    return F.coalesce(*[blank_to_null(F.trim(col(c))) for c in columns], F.lit(""))


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def strip_chars(c: Column | str, chars: str) -> Column:
    return F.btrim(col(c), F.lit(chars))


def drop_prefix(c: Column | str, *prefixes: str) -> Column:
    """The text without the given prefixes, each tried once in this order."""
    return F.regexp_replace(col(c), "^" + "".join(f"(?:{escape_regex(p)})?" for p in prefixes), "")


def drop_suffix(c: Column | str, suffix: str) -> Column:
    return F.regexp_replace(col(c), escape_regex(suffix) + r"\z", "")


def normalise_title(c: Column | str) -> Column:
    """Lower case, one space between words, no punctuation but the hyphen."""
    spaced = collapse_spaces(F.lower(text_or_empty(c)))
    return collapse_spaces(F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s-]", ""))


def short_digest(c: Column | str) -> Column:
    """First twelve hex digits of the SHA-1 of the UTF-8 text."""
    return F.left(F.sha1(F.encode(col(c), "UTF-8")), F.lit(12))


def slug(c: Column | str) -> Column:
    """Lower-case key of ``a-z 0-9 . _ -``; never empty (digest of the text instead)."""
    text = text_or_empty(c)
    body = strip_chars(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), "-")
    return F.coalesce(blank_to_null(body), F.concat(F.lit("u-"), short_digest(text)))


def title_key(c: Column | str, most: int | None = 96) -> Column:
    """Slug of a title, cut to ``most`` characters; with None it is whole."""
    return slug(c) if most is None else F.left(slug(c), F.lit(most))


def escape_regex(literal: str) -> str:
    """A literal for use inside a regular expression of Java, RE2 or Python."""
    return "".join(ch if ch.isalnum() or ch in "_ " or ord(ch) > 127 else "\\" + ch for ch in literal)


def _accent_table() -> tuple[str, str]:
    plain = {}
    for point in range(0x00C0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and parts[0].isascii():
            plain[chr(point)] = parts[0]
    return "".join(plain), "".join(plain.values())


_ACCENTED, _PLAIN = _accent_table()


def fold_text(c: Column | str) -> Column:
    """Lower case without the accents of Latin letters, whether composed or decomposed."""
    return F.translate(F.regexp_replace(F.lower(col(c)), "[\\u0300-\\u036f]", ""), _ACCENTED, _PLAIN)


def search_tokens(c: Column | str) -> Column:
    """Array of folded runs of letters and numbers, in text order."""
    return F.regexp_extract_all(fold_text(text_or_empty(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _chr(code_point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32")


def unescape_html(c: Column | str) -> Column:
    """Replace named and numeric character references that end in ``;``.

    The text is cut before every ``&`` and each piece is looked at once, so ``&amp;lt;`` gives ``&lt;``.
    """
    c = col(c)
    names = F.create_map(*[F.lit(v) for name, cp in name2codepoint.items() for v in (name, chr(cp))])

    def piece(p: Column) -> Column:
        named = F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]*);", 1)
        decimal = F.regexp_extract(p, r"^&#(0*[0-9]{1,7});", 1)
        hexadecimal = F.regexp_extract(p, r"^&#[xX](0*[0-9A-Fa-f]{1,6});", 1)
        number = F.when(decimal != "", decimal.try_cast("bigint")).when(
            hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("bigint")
        )
        usable = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        replacement = F.coalesce(
            F.when(named != "", F.try_element_at(names, named)),
            F.when(usable, _chr(number)),
        )
        rest = F.substring(p, F.locate(";", p) + 1, F.length(p))
        return F.when(replacement.isNotNull(), F.concat(replacement, rest)).otherwise(p)

    pieces = F.transform(F.split(c, "(?=&)"), lambda p: F.when(p.startswith("&"), piece(p)).otherwise(p))
    return F.when(c.contains("&"), F.array_join(pieces, "")).otherwise(c)
