"""Lookups in time: the last relevant call before another, the version at a date, and the package history behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import versions as V


def last_call(calls: DataFrame, relevant: Column, value: Column, within: Sequence[str], order: Sequence[str], name: str = "last", stop: Column | None = None) -> DataFrame:
    """For each call the value of the last relevant one before it in its group; null where there is none.

    A call that meets `stop` ends the search: what lies before it is not looked at. One window, one sort.
    """
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(relevant, F.struct(F.lit(True).alias("hit"), value.alias("value")))
    if stop is not None:
        hit = F.when(stop & ~relevant, F.struct(F.lit(False).alias("hit"), F.lit(None).cast("string").alias("value"))).otherwise(F.when(relevant, F.struct(F.lit(True).alias("hit"), value.cast("string").alias("value"))))
    found = calls.withColumn("_last", F.last(hit, ignorenulls=True).over(w))
    return found.withColumn(name, F.when(F.col("_last.hit"), F.col("_last.value"))).drop("_last")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """left with the right side's latest value at or before each row's time.

    Both sides go through one window instead of a join on a range, so a key's rows are sorted once and no row meets
    every earlier one.
    """
    keep = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), keep.alias("_row"))
    b = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(F.col(value).alias("v")).alias("_s"))
    a = a.select(*on, "_t", "_side", "_row", F.lit(None).cast(b.schema["_s"].dataType).alias("_s"))
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn(name, F.last("_s", ignorenulls=True).over(w)["v"])
    return found.where("_side = 1").select("_row.*", name)


def version_at(releases: DataFrame, at: DataFrame, by: str = "pkg", date: str = "date") -> DataFrame:
    """For each row (by, date) of `at` the highest version released by then: releases (by, version, released)."""
    r = releases.select(F.col(by).alias("_by"), "version", "released")
    keys = at.columns
    joined = at.join(r, (F.col(by) == F.col("_by")) & (F.col("released") <= F.col(date)), "left")
    return joined.groupBy(*keys).agg(V.highest(F.col("version")).alias("version"))


def decoded(deltas: DataFrame, delta: str, within: Sequence[str], order: Sequence[str], name: str = "value") -> DataFrame:
    """Delta-coded numbers: running sums."""
    return deltas.withColumn(name, F.sum(delta).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def encoded(values: DataFrame, value: str, within: Sequence[str], order: Sequence[str], name: str = "delta") -> DataFrame:
    before = F.lag(value, 1, 0).over(Window.partitionBy(*within).orderBy(*order))
    return values.withColumn(name, F.col(value) - before)


def survivors(allowed: DataFrame, item: str, constraint: str, within: Sequence[str] = ()) -> DataFrame:
    """Items that every constraint of their group allows: allowed has a row for each (constraint, item)."""
    total = allowed.groupBy(*within).agg(F.countDistinct(constraint).alias("_all"))
    each = allowed.groupBy(*within, item).agg(F.countDistinct(constraint).alias("_n"))
    # without groups the total is one row
    both = each.join(total, list(within)) if within else each.crossJoin(F.broadcast(total))
    return both.where("_n = _all").select(*within, item)


def in_range(rows: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """rows joined with the ranges [low, high) that hold their value: an equi-join on buckets of `width`, which should be
    about a range's, so that equal buckets meet and not all pairs."""
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    o = rows.withColumn("_bucket", F.floor(F.col(value) / width))
    return o.join(r, "_bucket").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bucket")


def preferred(sources: DataFrame, key: Sequence[str], priority: str, *ties: str) -> DataFrame:
    """Of several sources' rows for a key those of the first source that has any: no window over all columns, only the
    least priority is shuffled."""
    best = sources.groupBy(*key).agg(F.min(priority).alias("_best"))
    return sources.join(best, list(key)).where(F.col(priority) == F.col("_best")).drop("_best")


def sole_owner(exports: DataFrame, usage: DataFrame, fn: str = "fn", pkg: str = "pkg", weight: str = "downloads") -> DataFrame:
    """usage without a package gets the sole, else the most downloaded, exporter of its function."""
    owner = exports.groupBy(fn).agg(F.max_by(pkg, F.struct(weight, pkg)).alias("owner"), F.count("*").alias("exporters"))
    return usage.join(owner, fn, "left")


def match_arguments(args: DataFrame, formals: DataFrame, call: str = "call_id") -> DataFrame:
    """call, pos, formal: which formal parameter takes which argument.

    args (call, pos, name), formals (call, idx, formal); `...` is a formal like any other. In order: exact names; unique
    beginnings of names among formals before `...`; the rest by position among formals before `...`; what is left goes
    to `...`.
    """
    named, free = args.where("name is not null"), args.where("name is null")
    exact = named.join(formals, (named[call] == formals[call]) & (named["name"] == formals["formal"])).select(named[call].alias(call), "pos", "formal")
    open_ = formals.join(exact, [call, "formal"], "left_anti")
    dots = formals.where("formal = '...'").select(F.col(call).alias("_c"), F.col("idx").alias("_dots"))
    open_ = open_.join(dots, open_[call] == F.col("_c"), "left").drop("_c")
    before = open_.where("formal <> '...' and (_dots is null or idx < _dots)")
    rest = named.join(exact, [call, "pos"], "left_anti")
    b = before.select(F.col(call).alias("_c"), "formal")
    partial = rest.join(b, (rest[call] == F.col("_c")) & F.col("formal").startswith(F.col("name"))).drop("_c")
    partial = partial.withColumn("_n", F.count("*").over(Window.partitionBy(call, "pos"))).where("_n = 1").select(call, "pos", "formal")
    taken = exact.union(partial)
    left = before.join(partial, [call, "formal"], "left_anti")
    place = F.row_number().over(Window.partitionBy(call).orderBy("idx"))
    spots = left.select(call, "formal", place.alias("_i"))
    queue = free.select(call, "pos", F.row_number().over(Window.partitionBy(call).orderBy("pos")).alias("_i"))
    positional = queue.join(spots, [call, "_i"]).select(call, "pos", "formal")
    taken = taken.union(positional)
    others = args.join(taken, [call, "pos"], "left_anti").join(dots, args[call] == F.col("_c")).select(call, "pos", F.lit("...").alias("formal"))
    return taken.union(others)
