"""Patterns and token expressions shared by the operators.

All patterns are plain character classes with bounded repeats, so they run in linear time
on any text and mean the same in Java's and in RE2's syntax. Match them against
lower-cased text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = "[a-z0-9._%+-]{1,64}@[a-z0-9-]{1,63}[.][a-z0-9.-]{0,60}[a-z]"
PHONE = "[+]?[(]?[0-9][0-9 ().-]{7,18}[0-9]"
YEAR = "(19|20)[0-9][0-9]"
RANGE = "(19|20)[0-9][0-9] {0,3}(-|–|to) {0,3}((19|20)[0-9][0-9]|present|current|now)"
#: A month or year written so that a parser of dates is likely to misread it.
ODD_DATE = "(^|[^0-9'])'[0-9][0-9] {0,2}(-|–) {0,2}'[0-9][0-9]"
TERM, NOT_TERM = "[a-z0-9+#]+", "[^a-z0-9+#]+"
REPLACEMENT = "�"
SPACE = "[ \\t\\n\\x0b\\f\\r]+"


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def n_words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0b\\f\\r]+")).cast("long")


def terms(text: Column) -> Column:
    """Lower-case terms in order, repeats included."""
    # runs are found six times as fast as what parts them is cut out
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def has(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs; a letter that it needs is looked for first where it is a rare one."""
    found = F.lower(text).rlike(pattern)
    rare = {EMAIL: "@", ODD_DATE: "'"}.get(pattern)
    return F.coalesce(text.contains(rare) & found if rare else found, F.lit(False))
