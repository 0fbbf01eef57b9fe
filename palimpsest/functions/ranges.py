"""Ranges: struct<lower, upper, lower_inc, upper_inc, empty>, with a null bound for none; their text form and operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, bounds: str = "[)", discrete: bool = False) -> Column:
    """A range; ``discrete`` ones (integers, dates) are brought to the form [lower, upper)."""
    low_inc, up_inc = bounds[0] == "[", bounds[1] == "]"
    if discrete:
        lower = lower if low_inc else lower + 1
        upper = upper + 1 if up_inc else upper
        low_inc, up_inc = True, False
    empty = F.coalesce((lower > upper) | ((lower == upper) & F.lit(not (low_inc and up_inc))), F.lit(False))
    return F.struct(
        F.when(~empty, lower).alias("lower"), F.when(~empty, upper).alias("upper"), (F.lit(low_inc) & lower.isNotNull() & ~empty).alias("lower_inc"),
        (F.lit(up_inc) & upper.isNotNull() & ~empty).alias("upper_inc"), empty.alias("empty"),
    )


def parse(text: Column, type_: str = "bigint") -> Column:
    """A discrete range from its text, such as ``[1,5)``, ``(,7]`` or ``empty``."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract(text, r"^([\[(])([^,]*),([^\])]*)([\])])$", i)), F.lit("")).cast(type_)
    low = F.when(F.startswith(text, F.lit("(")), part(2) + 1).otherwise(part(2))
    high = F.when(F.endswith(text, F.lit("]")), part(3) + 1).otherwise(part(3))
    none = make(F.lit(1).cast(type_), F.lit(0).cast(type_))
    return F.when(text == "empty", none).otherwise(make(low, high))


def contains(r: Column, value: Column) -> Column:
    low = r["lower"].isNull() | (r["lower"] < value) | (r["lower_inc"] & (r["lower"] == value))
    high = r["upper"].isNull() | (r["upper"] > value) | (r["upper_inc"] & (r["upper"] == value))
    return ~r["empty"] & low & high


def overlap(a: Column, b: Column) -> Column:
    def before(x: Column, y: Column) -> Column:
        """x ends before y begins."""
        touch = (x["upper"] == y["lower"]) & ~(x["upper_inc"] & y["lower_inc"])
        return F.coalesce((x["upper"] < y["lower"]) | touch, F.lit(False))

    return ~a["empty"] & ~b["empty"] & ~before(a, b) & ~before(b, a)


def is_empty(r: Column) -> Column:
    return r["empty"]


def show(r: Column) -> Column:
    text = F.concat(F.when(r["lower_inc"], "[").otherwise("("), F.coalesce(r["lower"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["upper"].cast("string"), F.lit("")), F.when(r["upper_inc"], "]").otherwise(")"))
    return F.when(r["empty"], "empty").otherwise(text)
