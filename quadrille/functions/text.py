"""Texts as words, and lists of words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words in lower case: anything but ASCII letters, digits and underscores, with an apostrophe on one side of it, and one at an end.
SEPARATORS = r"'$|^'|'[^a-z_0-9']+|[^a-z_0-9']+'?"


def words(text: Column) -> Column:
    """The words of a text in lower case, in their order. Nothing here leaves code generation, as functions of array elements would."""
    # Two other characters become ASCII letters in lower case.
    plain = F.replace(F.replace(text, F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" "))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


_APART = re.compile(SEPARATORS.encode())
#: Bytes in lower case; what separates words, as all parts of other characters do, is a space.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "_'") else 32 for b in range(256))


def found(text: bytes) -> list[bytes]:
    """The same words of a text in UTF-8, in Python: many times faster, as there are expressions only where an apostrophe is at the edge of a word."""
    plain = text.translate(_PLAIN)
    if b"'" in plain and (b" '" in plain or b"' " in plain or plain.startswith(b"'") or plain.endswith(b"'")):
        return [w for w in _APART.split(plain) if w]
    return plain.split()


def split(text: Column, pattern: str = r"\b+") -> Column:
    """The parts of a text between matches of a pattern, without blank ones."""
    return F.filter(F.transform(F.split(text, pattern), lambda w: F.trim(w)), lambda w: w != "")


def has_any(tokens: Column, terms: list[str]) -> Column:
    """Whether one of the terms is among the tokens; true for an empty list of terms."""
    return F.arrays_overlap(tokens, F.array(*map(F.lit, terms))) if terms else F.lit(True)


def without(tokens: Column, stop: list[str]) -> Column:
    """The tokens that are no stop words; repeated ones stay."""
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens
