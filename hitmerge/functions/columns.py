"""Small building blocks shared by the column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, spelled out: faster than the property class and not ASCII-only like \\s.
WHITE_CHARS = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
WHITE = f"[{WHITE_CHARS}]"
WHITE_TEXT = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_white(c: Column) -> Column:
    """Strip Unicode white space on both ends (``trim`` strips ASCII spaces only)."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def squeeze_white(c: Column) -> Column:
    """Every white space run becomes one space, ends stripped. One pattern reads the text: once no other white space is left,
    plain ``trim`` strips the ends."""
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


def first_non_blank(*cols: Column) -> Column:
    """First value that holds more than white space, unchanged; '' when none does."""
    return F.coalesce(*[F.when(F.length(trim_white(c)) > 0, c) for c in cols], F.lit(""))


def char_class(chars: str) -> str:
    """The characters as the inside of a Java regexp class."""
    return "".join("\\" + ch if ch in "\\[]^-&|" else ch for ch in chars)
