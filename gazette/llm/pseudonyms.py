"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers, dates, addresses and keys are found by pattern and validated (check digits, calendar, ranges). Each valid
value is permuted within its own format by a keyed Feistel network, so it stays valid, equal values get equal pseudonyms
in all documents, whatever their punctuation, and the holder of the key can turn them back. No table of values is
kept and no row leaves its task.

Defined cases: a null text stays null and an empty one empty, both with zero counts; of overlapping finds the earlier
form of ``FORMS`` wins, and later forms are searched in the gaps; rows never meet, so ties, repeated rows and null
identifiers need no rule; a long text is worked on alone; other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gazette.llm.common import bounded_batches

ROUNDS = 10
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of the numbers below a bound, by alternating additions on two digits of unlike base."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, i: int, size: int, value: int, base: int) -> int:
        form = "" if base < 1 << 192 else "x"
        data = f"{kind}|{i}|{size:{form}}|{value:{form}}".encode()
        digest = hashlib.blake2b(data, key=self.key, digest_size=24).digest()
        for block in range((base.bit_length() - 1) // 192):
            digest += hashlib.blake2b(b"%d|%b" % (block, data), key=self.key, digest_size=24).digest()
        return int.from_bytes(digest, "little") % base

    def _once(self, value: int, size: int, kind: str, back: bool) -> int:
        a = max(1, round(size**0.5)) if size < 1 << 50 else 1 << (size.bit_length() // 2)
        b = -(-size // a)
        x, y = divmod(value, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                step = self._round(kind, i, size, y, a)
                x = (x - step if back else x + step) % a
            else:
                step = self._round(kind, i, size, x, b)
                y = (y - step if back else y + step) % b
        return x * b + y

    def permute(self, value: int, size: int, kind: str, back: bool = False, valid: Callable[[int], bool] | None = None) -> int:
        """The image of ``value`` below ``size``; images that are out of range or not valid are mapped again."""
        while True:
            value = self._once(value, size, kind, back)
            if value < size and (valid is None or valid(value)):
                return value


def luhn(digits: str) -> int:
    """Check digit for a row of digits."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _shaped(text: str, chars: str) -> str:
    """``text`` with its letters and digits replaced by ``chars`` in order."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in text)


def _string(net: Feistel, value: str, kind: str, back: bool) -> str:
    """Letters and digits of a string, each within its own class."""
    classes = [(48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26) for c in value]
    number, size = 0, 1
    for c, (start, base) in zip(value, classes):
        number, size = number * base + ord(c) - start, size * base
    number, out = net.permute(number, size, kind, back), []
    for start, base in reversed(classes):
        number, digit = divmod(number, base)
        out.append(chr(start + digit))
    return "".join(reversed(out))


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _email(net: Feistel, text: str, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    chars = "".join(c for c in local if c.isalnum())
    return f"{_shaped(local, _string(net, chars, f'email|{domain.lower()}', back))}@{domain}" if chars else None


def _address(net: Feistel, text: str, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    number = net.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "address", back)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _card(net: Feistel, text: str, back: bool) -> str | None:
    digits = _digits(text)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + _string(net, digits[1:-1], "card", back)
    return _shaped(text, f"{body}{luhn(body)}")


def _iban(net: Feistel, text: str, back: bool) -> str | None:
    chars = text.replace(" ", "")
    if len(chars) != _IBAN_LENGTHS.get(chars[:2], len(chars)):
        return None
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(chars[4:] + chars[:4]) % 97 != 1:
        return None
    body = _string(net, chars[4:], f"iban|{chars[:2]}", back)
    return _shaped(text, f"{chars[:2]}{98 - number(body + chars[:2] + '00') % 97:02}{body}")


def _ten(digits: str) -> int:
    """Class of ten digits: trunk zero, area code and exchange of the US plan, or neither. Images stay in their class."""
    return 0 if digits[0] == "0" else 1 if digits[0] in "23456789" and digits[3] in "23456789" else 2


def _us(net: Feistel, body: str, back: bool) -> str:
    number = net.permute(int(body), 10**10, "phone", back, lambda v: _ten(f"{v:010}") == _ten(body))
    return f"{number:010}"


def _country(digits: str) -> str:
    """The country code at the start of an international number."""
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3]


def _international(net: Feistel, text: str, back: bool, exact: bool = False) -> str | None:
    """The code and a trunk zero in brackets stay; plans 1 and 39 have none, there a zero is part of the number.
    With ``exact``, only numbers as long as the plan of the country has them."""
    prefix = "" if text[0] == "+" else "00"
    code = _country(_digits(text)[len(prefix) :])
    left, trunk, right = (text, "", "") if code in ("1", "39") else text.partition("(0")
    digits = _digits(left + right)[len(prefix) :]
    rest = digits[len(code) :]
    least, most = _LENGTHS.get(code, (0, 15)) if exact else (0, 15)
    if text.isdigit() or not 8 <= len(digits) <= 15 or not least <= len(rest) <= most:
        return None
    if code == "1" and len(rest) == 10:
        rest = _us(net, rest, back)
    else:
        zero, size = rest[0] == "0", 10 ** len(rest)
        number = net.permute(int(rest), size, f"phone|{code}", back, lambda v: (10 * v < size) == zero)
        rest = f"{number:0{len(rest)}}"
    new = _shaped(left + right, f"{prefix}{code}{rest}")
    return f"{new[: len(left)]}{trunk}{new[len(left) :]}"


def _phone(net: Feistel, text: str, back: bool) -> str | None:
    digits = _digits(text)
    if text.startswith(("+", "00")):
        return _international(net, text, back, exact=True)
    if digits == text:
        return None
    if digits[0] == "0":
        least = 10 ** (len(digits) - 2)
        number = net.permute(int(digits[1:]), 10 * least, "phone|0", back, lambda v: v >= least)
        return _shaped(text, f"0{number}")
    us = _US_FORM.fullmatch(text)
    if us or len(digits) == 10:
        head, body = digits[:-10], digits[-10:]
        if text[0] != "(" and not us and _ten(body) != 1:
            return None
        return _shaped(text, head + _us(net, body, back))
    least = 10 ** (len(digits) - 1)
    return _shaped(text, str(net.permute(int(digits), 10 * least, "phone|", back, lambda v: v >= least)))


def _social(net: Feistel, text: str, back: bool) -> str | None:
    def valid(v: int) -> bool:
        s = f"{v:09}"
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    number = int(_digits(text))
    return _shaped(text, f"{net.permute(number, 10**9, 'social', back, valid):09}") if valid(number) else None


def _date(net: Feistel, text: str, back: bool) -> str | None:
    form = "%Y-%m-%d" if text[4] == "-" else "%d.%m.%Y" if "." in text else "%m/%d/%Y"
    try:
        day = datetime.datetime.strptime(text, form).date().toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    number = net.permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date", back)
    return datetime.date.fromordinal(_FIRST_DAY + number).strftime(form)


def _key(net: Feistel, text: str, back: bool) -> str | None:
    head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", text)[0]
    rest = text[len(head) :]
    return head + _shaped(rest, _string(net, "".join(c for c in rest if c.isalnum()), f"key|{head}", back))


def _hex(net: Feistel, text: str, kind: str, back: bool) -> str:
    """Hexadecimal digits; a text of decimal digits, of letters in one case and of both cases stays one."""
    if text.isdigit():
        return _string(net, text, kind, back)
    mixed = text.upper() != text and text.lower() != text
    chars = "0123456789abcdefABCDEF" if mixed else "0123456789abcdef"

    def string(number: int) -> str:
        out = []
        for _ in text:
            number, digit = divmod(number, len(chars))
            out.append(chars[digit])
        return "".join(reversed(out))

    def valid(number: int) -> bool:
        new = string(number)
        return new.upper() != new and new.lower() != new if mixed else not new.isdigit()

    number = 0
    for c in text if mixed else text.lower():
        number = number * len(chars) + chars.index(c)
    new = string(net.permute(number, len(chars) ** len(text), f"{kind}|{len(chars)}", back, valid))
    return new.upper() if text.upper() == text else new


def _secret(net: Feistel, text: str, back: bool) -> str | None:
    """The quoted value behind its name, in pieces of at most 256 digits."""
    found = _SECRET.fullmatch(text)
    pieces = (_hex(net, found[2][i : i + 256], f"hex|{i}", back) for i in range(0, len(found[2]), 256))
    return text[: found.start(2)] + "".join(pieces) + text[found.end(2) :]


#: Characters of an IBAN by country; of other countries any length may pass the check.
_IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (
        row.split(":")
        for row in (
            "15:NO|16:BE|18:DK FI FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH CR HR LI LV|22:BG BH DE GB GE IE ME RS VA|"
            "23:AE GI IL IQ OM SO TL|24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST|26:IS TR|27:BI DJ FR GR IT MC MR SM|"
            "28:AL AZ BY CY DO GT HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU"
        ).split("|")
    )
    for country in countries.split()
}
#: Least and most digits behind a country code; of other countries all that give 8 to 15 digits with the code.
_LENGTHS = {
    code: (int(least), int(most))
    for code, least, most in (
        row.split()
        for row in (
            "1 10 10,7 10 10,20 8 10,27 9 9,30 10 10,31 9 9,32 8 9,33 9 9,34 9 9,36 8 9,39 6 11,40 9 9,41 9 9,43 7 12,44 9 10,45 8 8,"
            "46 7 10,47 8 8,48 9 9,49 6 11,51 8 9,52 10 11,54 10 11,55 10 11,56 9 9,57 8 10,60 8 10,61 9 9,62 8 12,63 8 10,64 8 10,65 8 8,"
            "66 8 9,81 9 10,82 8 10,84 9 10,86 10 11,90 10 10,91 10 10,92 9 10,351 9 9,353 7 9,358 6 11,420 9 9,421 9 9,852 8 8,886 8 9,"
            "971 8 9,972 8 9"
        ).split(",")
    )
}
#: Country codes of two digits; 1 and 7 stand alone and all others have three.
_TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: Digits per group of national phone numbers written with a trunk zero, an area code in brackets, or ten digits.
_GROUPS = (
    "2 3 2 2,2 3 3 2,3 3 2 2,4 2 2 2,2 4 4,2 5 4,3 3 3,3 3 4,3 4 3,3 4 4,4 3 3,4 3 4,4 4 4,5 3 3,"
    "2 7,2 8,3 6,3 7,3 8,4 5,4 6,4 7,4 8,5 4,5 5,5 6,5 7"
)


def _national() -> str:
    """Pattern of the national forms, those of more groups first."""
    forms = [r"(?:\(0[1-9]\)|0[1-9]|[2-9][0-9])([ .-])[0-9]{2}(?:\1[0-9]{2}){3}"]
    shapes = sorted((tuple(map(int, g.split())) for g in _GROUPS.split(",")), key=lambda g: (-len(g), -sum(g), g))
    for first, *rest in shapes:
        tail = "[ .-]".join(f"[0-9]{{{n}}}" for n in rest)
        plain = f"0[1-9][0-9]{{{first - 2}}}" + ("|[1-9]" + f"[0-9]{{{first - 1}}}" if first + sum(rest) == 10 else "")
        forms.append(rf"(?:\((?!00)[0-9]{{{first}}}\)[ ./-]?|(?:{plain}){'[ ./-]' if len(rest) > 1 else '[ /-]'}){tail}")
    return "|".join([_US_FORM.pattern, *forms])


#: Three, three and four digits, with or without the long-distance 1.
_US_FORM = re.compile(r"(?:1[ .-])?(?:\([1-9][0-9]{2}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[1-9][0-9]{2}(?:[ .-][0-9]{3}[ .-]?|[0-9]{3}[ .-])[0-9]{4})")
_INTERNATIONAL = r"(?:\+|00)\(?[1-9][0-9]{0,14}\)?(?:[ .-]?\([0-9]{1,5}\))?(?:[ .-]?[0-9]{1,14}){0,14}"

#: A quoted hexadecimal value of 16 digits or more behind a name like token, api_key or "secret".
_SECRET = re.compile(r"""(?i:token|key|secret|passw(?:or)?d|passphrase|pwd|credential|auth|bearer)[\w-]{0,32}(?:\\?["'])?\s{0,8}(?:=>|:=|[=:])?\s{0,8}(\\?["'])(?:0[xX])?([0-9a-fA-F]{16,}+)\1""")

_LETTER, _DIGIT, _WORD = re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile("[A-Za-z0-9]")
#: Forms in order of priority: the kind, what must stand in a text for the pattern to be tried, the pattern, what must not follow
#: a find, the permutation.
FORMS: list[tuple[str, str | re.Pattern, re.Pattern, re.Pattern, Callable]] = [
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"), _LETTER, _email),
    ("key", "", re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|sk-(?=[A-Za-z0-9_-]*[0-9])(?=(?:[_-]?[A-Za-z0-9]){20})[A-Za-z0-9_-]*[A-Za-z0-9])"), _WORD, _key),
    ("key", re.compile(r"""["'](?:0[xX])?[0-9a-fA-F]{16}"""), _SECRET, re.compile("(?!)"), _secret),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"), _WORD, _iban),
    ("address", ".", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), re.compile(r"\.?[0-9]"), _address),
    ("date", "", re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})"), _DIGIT, _date),
    ("social", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}"), re.compile("[0-9-]"), _social),
    ("card", "", re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})"), _DIGIT, _card),
    ("phone", "", re.compile(rf"(?<![0-9+])(?=[+(]|[0-9]+[ ./(-])(?:{_INTERNATIONAL}|{_national()})"), _DIGIT, _phone),
    ("phone", "", re.compile(rf"(?<![0-9+]){_INTERNATIONAL}"), _DIGIT, _international),
]
KINDS = tuple(dict.fromkeys(form[0] for form in FORMS))
#: Every pattern needs one of these.
_HINT = re.compile(r"[0-9@]|A[KS]IA|sk-|gh[pousr]_|[\"'][a-fA-F]{16}")


def _gaps(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Where no find stands."""
    taken.sort()
    return list(zip([0, *(b for _, b, _ in taken)], [*(a for a, _, _ in taken), len(text)]))


def _finds(text: str, gap: tuple[int, int], pattern: re.Pattern, after: re.Pattern, new_of: Callable) -> Iterator[tuple[int, int, str]]:
    """Finds in a gap: of a match that is refused the shorter forms are tried, then the next start."""
    at, stop = gap
    while m := pattern.search(text, at, stop):
        at = m.start() + 1
        while m:
            if not after.match(text, m.end()) and (new := new_of(m[0])) is not None:
                yield m.start(), m.end(), new
                at = m.end()
                break
            m = pattern.match(text, m.start(), m.end() - 1)


def replace(net: Feistel, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms (with ``back``, with the values they stand for), and the finds of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not _HINT.search(text):
        return text, counts
    taken: list[tuple[int, int, str]] = []
    for kind, hint, pattern, after, permute in FORMS:
        if hint in text if isinstance(hint, str) else hint.search(text):
            for gap in _gaps(text, taken):
                for find in _finds(text, gap, pattern, after, lambda value: permute(net, value, back)):  # noqa: B023
                    taken.append(find)
                    counts[kind] += 1
    taken.sort()
    out, at = [], 0
    for a, b, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, clean_text and the number of replaced values of each kind, for every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Feistel(key)
        for batch in batches:
            done = [(None, dict.fromkeys(KINDS, 0)) if t is None else replace(net, t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS]
            names = ["doc_id", "clean_text", *(f"n_{k}" for k in KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), *counts], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, clean_text string, " + ", ".join(f"n_{k} bigint" for k in KINDS))
