"""Text normalisation and similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags of :func:`normalize`.
TRIM, COLLAPSE, STRIP_CONTROL, FOLD_FULLWIDTH = 1, 2, 4, 8
ALL = TRIM | COLLAPSE | STRIP_CONTROL | FOLD_FULLWIDTH

_SPACE = r"[ \t\n\x0B\f\r]+"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def normalize(text: Column, flags: int = ALL) -> Column:
    """Fold full-width forms, drop control characters other than white space, make one space of each run of white space
    (runs at the ends go), trim: in this order, as far as ``flags`` asks."""
    if flags & FOLD_FULLWIDTH:
        text = F.translate(text, _WIDE, _NARROW)
    if flags & STRIP_CONTROL:
        text = F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F-\x9F]", "")
    if flags & COLLAPSE:
        text = F.trim(F.regexp_replace(text, _SPACE, " "))
    if flags & TRIM:
        text = F.regexp_replace(text, f"^{_SPACE}|{_SPACE}$", "")
    return text


def as_bytes(text: Column) -> Column:
    """A string with one character per UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, over bytes; 0 if either is empty."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1.0 - F.levenshtein(as_bytes(a), as_bytes(b)) / longer)


def truncated(text: Column, most: int = 1024) -> Column:
    """The first ``most`` bytes, without a character cut in two at the end."""
    part = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(part, "�+$", ""))


#: Names of the result codes, in order.
ERROR_CODES = ["Ok", "InvalidArgument", "UnsupportedFormat", "CoordinateTransform", "BackendUnavailable", "BackendFailure", "Timeout", "Cancelled", "CacheCorrupt", "BudgetExceeded"]


def error_code_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, ERROR_CODES)), code.cast("int")), F.lit("Unknown"))
