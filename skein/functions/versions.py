"""Package versions and ranges as Columns.

A version is text such as 1.2-3: whole numbers with dots or hyphens between. Its key, an array of whole numbers, sorts
versions; missing parts count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts that a key holds; versions with more keep the rest as a tie.
PARTS = 6


def parse(version: Column) -> Column:
    """The key of a version, or NULL where it is none."""
    text = F.trim(version)
    parts = F.transform(F.split(text, "[.-]"), lambda x: x.try_cast("long"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("long"), PARTS)), 1, F.greatest(F.size(parts), F.lit(PARTS)))
    return F.when(text.rlike(r"^\d+([.-]\d+)*$"), padded)


def satisfies(version: Column, constraint: Column) -> Column:
    """Whether a version meets constraints such as `>= 1.2, < 2`; an empty or `*` constraint is met by any."""
    key = parse(version)

    def one(c: Column) -> Column:
        sign, bound = F.regexp_extract(c, r"^\s*(>=|<=|==|!=|=|>|<)?", 1), parse(F.regexp_replace(c, r"^\s*(>=|<=|==|!=|=|>|<)?\s*", ""))
        met = F.when(sign == ">=", key >= bound).when(sign == "<=", key <= bound).when(sign == ">", key > bound).when(sign == "<", key < bound)
        return F.when(F.trim(c).isin("", "*"), F.lit(True)).otherwise(met.when(sign == "!=", key != bound).otherwise(key == bound))

    return F.forall(F.split(constraint, ","), one)


def highest(version: Column) -> Column:
    """The highest version of a group."""
    return F.max_by(version, parse(version))


def bounds(constraint: Column) -> Column:
    """struct<low, low_in, high, high_in> of constraints such as `>= 1.2, < 2`: keys as of parse(), null where open. An
    equality bounds both ways; `!=` bounds nothing."""
    part = r"^\s*(>=|<=|==|!=|=|>|<)?\s*(.*)$"
    parts = F.transform(F.split(constraint, ","), lambda c: F.struct(F.regexp_extract(c, part, 1).alias("sign"), parse(F.regexp_extract(c, part, 2)).alias("key")))
    lows = F.filter(parts, lambda p: p["sign"].isin(">=", ">", "=", "==", "") & p["key"].isNotNull())
    highs = F.filter(parts, lambda p: p["sign"].isin("<=", "<", "=", "==", "") & p["key"].isNotNull())
    # of equal keys the open bound is the tighter one
    low = F.array_max(F.transform(lows, lambda p: F.struct(p["key"].alias("key"), (p["sign"] == ">").alias("out"))))
    high = F.array_min(F.transform(highs, lambda p: F.struct(p["key"].alias("key"), (p["sign"] != "<").alias("inside"))))
    return F.struct(low["key"].alias("low"), (~low["out"]).alias("low_in"), high["key"].alias("high"), high["inside"].alias("high_in"))


def intersect(a: Column, b: Column) -> Column:
    """The constraint that meets both."""
    clean = lambda c: F.nullif(F.trim(c), F.lit("*"))
    return F.concat_ws(", ", F.nullif(clean(a), F.lit("")), F.nullif(clean(b), F.lit("")))


def empty(constraint: Column) -> Column:
    """Whether no version can meet the constraint."""
    x = bounds(constraint)
    return F.coalesce((x["low"] > x["high"]) | ((x["low"] == x["high"]) & ~(x["low_in"] & x["high_in"])), F.lit(False))


def satisfies_any(version: Column, constraints: Column) -> Column:
    """Whether a version meets any of an array of constraints."""
    return F.exists(constraints, lambda c: satisfies(version, c))
