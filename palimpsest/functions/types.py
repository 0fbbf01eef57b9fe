"""Orders and checks that a type brings: enums, domains, text search, bit strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_order(value: Column, labels: Sequence[str]) -> Column:
    """Place of an enum value in its declaration; null for a null."""
    return F.when(value.isNotNull(), F.array_position(F.array(*[F.lit(x) for x in labels]), value).cast("int"))


def enum_check(value: Column, labels: Sequence[str]) -> Column:
    return value.isNull() | value.isin(list(labels))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits: what a text search matches."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""))


def fts_match(words: Column, query: str) -> Column:
    """``a & b | !c``: all of, any of and none of; | binds loosest."""
    out = F.lit(False)
    for branch in query.lower().split("|"):
        part = F.lit(True)
        for term in branch.split("&"):
            term = term.strip()
            hit = F.array_contains(words, term.lstrip("!").strip())
            part = part & (~hit if term.startswith("!") else hit)
        out = out | part
    return out


def bit_and_mask(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask))


def char_pad(value: Column, n: int) -> Column:
    """char(n): padded with blanks, longer values cut as a cast does."""
    return F.rpad(value, n, " ")
