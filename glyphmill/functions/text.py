"""Column functions on recognised text: code points, widths, case, character classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII = "".join(map(chr, range(0x20, 0x7F)))
_FULL = "　" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_HALF_FROM = "".join(chr(c) for c in range(0xFF00, 0xFF60))
_HALF_TO = "".join(chr(c - 0xFEE0) for c in range(0xFF00, 0xFF60))

# The case pairs of Latin-1 and Cyrillic: a rule, without the signs for times and division.
_UPPER = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF), *range(0x410, 0x430)] if c != 0xD7) + "ЁŸ"
_LOWER = "".join(chr(c + 32) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF), *range(0x410, 0x430)] if c != 0xD7) + "ёÿ"

# Punctuation outside ASCII that counts as such for Chinese text.
CHINESE_PUNCTUATION = [183, 215, 247, 8212, 8216, 8217, 8220, 8221, 8230, 12289, 12290, 12298, 12299, 12302, 12303, 12304, 12305]
# Code ranges of punctuation for European text.
EUROPEAN_PUNCTUATION = [(0x20, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0xA0, 0xBF), (0x2000, 0x206F), (0x2E00, 0x2E7F)]
_ASCII_PUNCTUATION = [(32, 47), (58, 64), (91, 96), (123, 126)]


def characters(text: Column) -> Column:
    """The characters of a text as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def code_points(text: Column) -> Column:
    """Unicode code points of a text."""
    return F.transform(characters(text), lambda c: F.ascii(c))


def to_full_width(text: Column) -> Column:
    """ASCII as full-width forms, the space as an ideographic space."""
    return F.translate(text, _ASCII, _FULL)


def to_half_width(text: Column) -> Column:
    """Full-width forms from U+FF00 up to U+FF5F as what lies 0xFEE0 below."""
    return F.translate(text, _HALF_FROM, _HALF_TO)


def lower_european(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def upper_european(text: Column) -> Column:
    return F.translate(text, _LOWER, _UPPER)


def capitalised(text: Column) -> Column:
    """First letter upper, the rest as it stands."""
    return F.concat(upper_european(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def _between(code: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | code.between(low, high)
    return out


def is_chinese(text: Column) -> Column:
    """Whether the first character is a common ideograph."""
    return F.ascii(text).between(0x4E00, 0x9FBB)


def is_chinese_punctuation(letter: Column) -> Column:
    """Whether a character is punctuation, full-width forms folded first."""
    code = F.ascii(letter)
    code = F.when((code >= 0xFEE0) & (code < 0xFF60), code - 0xFEE0).otherwise(code)
    return _between(code, _ASCII_PUNCTUATION) | code.isin(CHINESE_PUNCTUATION)


def is_european_punctuation(letter: Column) -> Column:
    return _between(F.ascii(letter), EUROPEAN_PUNCTUATION)


def is_not_alphanumeric(letter: Column) -> Column:
    """Anything but A-Z, a-z and 0-9, the space included."""
    return ~letter.rlike("^[A-Za-z0-9]")


def char_class(letter: Column) -> Column:
    """1 digit, 2 Latin letter, 3 anything else."""
    return F.when(letter.rlike("^[0-9]"), 1).when(letter.rlike("^[A-Za-z]"), 2).otherwise(3)


def letter_case(text: Column) -> Column:
    """By the first Latin letter: upper, lower, or null if there is none."""
    first = F.regexp_extract(text, "[A-Za-z]", 0)
    return F.when(first == "", None).when(first == F.upper(first), "upper").otherwise("lower")


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def quote_position(text: Column) -> Column:
    """Where the only apostrophe of a word is, from 0; -1 if there is none or more than one."""
    at = F.instr(text, "'") - 1
    many = F.length(text) - F.length(F.replace(text, F.lit("'"), F.lit(""))) > 1
    return F.when(many, -1).otherwise(at)


def without_quote(text: Column) -> Column:
    return F.when(quote_position(text) >= 0, F.replace(text, F.lit("'"), F.lit(""))).otherwise(text)


def with_quote(text: Column, position: Column) -> Column:
    """The apostrophe put back, unless it was at the start."""
    return F.when(position >= 1, F.concat(F.left(text, position), F.lit("'"), F.substr(text, position + 1))).otherwise(text)


def high_low(text: Column, kind: Column) -> Column:
    """Lower case, then upper for kind 2 and a capital first letter for kind 1."""
    low = F.lower(text)
    return F.when(kind == 2, F.upper(low)).when(kind == 1, F.concat(F.upper(F.left(low, F.lit(1))), F.substr(low, F.lit(2)))).otherwise(low)


def split_keep_inner(text: Column, separator: str) -> Column:
    """Pieces between separators; only an empty last piece is dropped."""
    pieces = F.split(text, re.escape(separator))
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def charset_filter(text: Column) -> Column:
    """Only common ideographs, digits and Latin letters."""
    return F.regexp_replace(text, "[^\\x{4E00}-\\x{9FA5}0-9A-Za-z]", "")


def text_of_path(path: Column, labels: Column) -> Column:
    """Labels of class ids, joined; ids outside the table give nothing."""
    return F.array_join(F.transform(path, lambda i: F.try_element_at(labels, i + 1)), "")
