"""Data-frame verbs: the relational operators that analysed programs use, as DataFrame functions.

Frames have no row order of their own: verbs that depend on one (head, tail, slice, cbind) take it as `by`, columns or
expressions that tell all rows apart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.storage import stored

By = Sequence[str | Column]


# columns


def select(df: DataFrame, *columns: str | Column, drop: Sequence[str] = ()) -> DataFrame:
    """The named columns, or all but the dropped ones."""
    return df.drop(*drop) if drop else df.select(*columns)


def relocate(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def rename(df: DataFrame, **new_old: str) -> DataFrame:
    """new=old for each column to rename."""
    return df.withColumnsRenamed({old: new for new, old in new_old.items()})


def rename_with(df: DataFrame, f: Callable[[str], str], columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({c: f(c) for c in (columns or df.columns)})


def set_names(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def mutate(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns one after the other, so later ones may use earlier ones; None deletes."""
    for name, value in columns.items():
        df = df.drop(name) if value is None else df.withColumn(name, value)
    return df


def transmute(df: DataFrame, **columns: Column) -> DataFrame:
    return mutate(df, **columns).select(*columns)


def across(df: DataFrame, f: Callable[[Column], Column], columns: Sequence[str] | None = None, where: Callable[[str], bool] | None = None) -> DataFrame:
    """f applied to the chosen columns: by name, by type name, or all."""
    kinds = dict(df.dtypes)
    chosen = [c for c in (columns or df.columns) if where is None or where(kinds[c])]
    return df.withColumns({c: f(F.col(c)) for c in chosen})


def select_if(df: DataFrame, where: Callable[[str], bool]) -> DataFrame:
    return df.select(*[c for c, kind in df.dtypes if where(kind)])


def unite(df: DataFrame, name: str, *columns: str, sep: str = "_") -> DataFrame:
    """One column of the others' text; missing values read NA."""
    text = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])
    return df.withColumn(name, text).drop(*[c for c in columns if c != name])


def separate(df: DataFrame, column: str, into: Sequence[str], sep: str) -> DataFrame:
    """A column cut at a regular expression: missing pieces are null, further ones are dropped."""
    pieces = F.split(F.col(column), sep)
    return df.withColumns({n: F.try_element_at(pieces, F.lit(i + 1)) for i, n in enumerate(into)}).drop(*({column} - set(into)))


def separate_at(df: DataFrame, column: str, widths: dict[str, int]) -> DataFrame:
    """A column cut by widths, in order."""
    at = 1
    for name, width in widths.items():
        df = df.withColumn(name, F.substring(column, at, width))
        at += width
    return df.drop(*({column} - set(widths)))


# rows


def subset(df: DataFrame, condition: Column | str, *columns: str) -> DataFrame:
    out = df.filter(condition)
    return out.select(*columns) if columns else out


def arrange(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.orderBy(*by)


def numbered(df: DataFrame, by: By, name: str = "_row") -> DataFrame:
    """Rows numbered from 1 in the order of `by`, without a sort in one task: range partitions get their first number
    from the counts of those before. The partitions are stored, so that counts and numbers are of the same ones."""
    parts = df.repartitionByRange(*[c if isinstance(c, Column) else F.col(c) for c in by]).sortWithinPartitions(*by)
    parts = parts.withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
    parts = stored(parts.select(*df.columns, part, place), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return parts.join(F.broadcast(first), "_part").select(*df.columns, (F.col("_first") + F.col("_place") + 1).alias(name))


def head(df: DataFrame, n: int, by: By) -> DataFrame:
    """The first n rows; with n below 0 all but the last -n."""
    if n >= 0:
        return df.orderBy(*by).limit(n)
    rows = numbered(df, by)
    return rows.where(F.col("_row") <= df.count() + n).drop("_row")


def tail(df: DataFrame, n: int, by: By) -> DataFrame:
    """The last n rows; with n below 0 all but the first -n."""
    if n < 0:
        return df.orderBy(*by).offset(-n)
    return df.orderBy(*[(c if isinstance(c, Column) else F.col(c)).desc() for c in by]).limit(n)


def slice_rows(df: DataFrame, places: Sequence[int], by: By) -> DataFrame:
    """Rows at places counted from 1; negative places are left out."""
    row = F.col("_row")
    gone = places and all(p < 0 for p in places)
    return numbered(df, by).where(~row.isin([-p for p in places]) if gone else row.isin(list(places))).drop("_row")


def slice_max(df: DataFrame, column: str, n: int = 1, within: By = (), least: bool = False) -> DataFrame:
    """The rows with the n largest (or least) values, ties included, in each group."""
    order = F.col(column).asc_nulls_last() if least else F.col(column).desc_nulls_last()
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*within).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


def slice_sample(df: DataFrame, fraction: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """A seeded sample; with a key, rows of one key stay together and reruns agree whatever the partitions."""
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def equidistant(df: DataFrame, every: int, by: By) -> DataFrame:
    return numbered(df, by).where((F.col("_row") - 1) % every == 0).drop("_row")


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows, or the distinct values of the columns."""
    return (df.select(*columns) if columns else df).distinct()


def drop_na(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns) or None)


def replace_na(df: DataFrame, **values: object) -> DataFrame:
    return df.na.fill(values)


def fill(df: DataFrame, column: str, by: By, within: By = ()) -> DataFrame:
    """Missing values take the last one before them."""
    w = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


# groups


def summarise(df: DataFrame, by: By = (), **values: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in values.items()])


def count(df: DataFrame, *by: str, weight: str | None = None, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(weight) if weight else F.count("*")).alias(name))


def add_count(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*by)))


# two frames


def join(left: DataFrame, right: DataFrame, by: Sequence[str] | dict[str, str] | None = None, how: str = "inner", suffixes: tuple[str, str] = (".x", ".y")) -> DataFrame:
    """A join on columns of the same name, on {left: right} pairs, or on all common names (None); no columns: a cross
    join. Other columns that both sides have get suffixes; missing keys match missing keys, as programs expect."""
    if by is None:
        by = [c for c in left.columns if c in right.columns]
    pairs = by if isinstance(by, dict) else {c: c for c in by}
    if how in ("semi", "anti"):
        r = right.select(*[F.col(b).alias(f"_{i}") for i, b in enumerate(pairs.values())])
        return left.join(r, _equal(left, pairs), f"left_{how}")
    clash = (set(left.columns) - set(pairs)) & (set(right.columns) - set(pairs.values()))
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    if not pairs:
        return left.crossJoin(right)
    named = lambda c: F.col(f"`{c}`")
    rest = [named(c) for c in right.columns if c not in pairs.values()]
    r = right.select(*[named(b).alias(f"_{i}") for i, b in enumerate(pairs.values())], *rest)
    out = left.join(r, _equal(left, pairs), how)
    keys = [F.coalesce(named(a), F.col(f"_{i}")).alias(a) for i, a in enumerate(pairs)]
    return out.select(*keys, *[named(c) for c in left.columns if c not in pairs], *rest)


def _equal(left: DataFrame, pairs: dict[str, str]) -> Column:
    cond = F.lit(True)
    for i, a in enumerate(pairs):
        cond = cond & F.col(f"`{a}`").eqNullSafe(F.col(f"_{i}"))
    return cond


def nest_join(left: DataFrame, right: DataFrame, by: Sequence[str], name: str = "nested") -> DataFrame:
    """left with an array of the right rows that match, sorted; empty where none does."""
    rest = [c for c in right.columns if c not in by]
    kind = "array<struct<" + ",".join(f"{k}:{t}" for k, t in right.dtypes if k in rest) + ">>"
    nested = right.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    return left.join(nested, list(by), "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def bind_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def bind_cols(left: DataFrame, right: DataFrame, by_left: By, by_right: By) -> DataFrame:
    """Rows side by side, by their places in the given orders."""
    return numbered(left, by_left).join(numbered(right, by_right), "_row").drop("_row")


def rows_insert(df: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """df and the new rows whose keys it lacks."""
    return df.unionByName(new.join(df, list(by), "left_anti"), allowMissingColumns=True)


def rows_update(df: DataFrame, new: DataFrame, by: Sequence[str], patch: bool = False) -> DataFrame:
    """df with the new values of matching keys; with patch only where df has none."""
    values = [c for c in new.columns if c not in by]
    n = new.select(*by, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_new"))
    out = df.join(n, list(by), "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")) if patch else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
    return out.select(*[pick(c).alias(c) if c in values else F.col(c) for c in df.columns])


def rows_upsert(df: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows_insert(rows_update(df, new, by), new, by)


def rows_delete(df: DataFrame, gone: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(gone, list(by), "left_anti")


# shape


def pivot_longer(df: DataFrame, columns: Sequence[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
    return df.unpivot([c for c in df.columns if c not in columns], list(columns), names_to, values_to)


def pivot_wider(df: DataFrame, ids: Sequence[str], names_from: str, value: Column, names: Sequence[object]) -> DataFrame:
    """One column for each of the names, which are given, so no extra pass looks for them."""
    return df.groupBy(*ids).pivot(names_from, list(names)).agg(value)


def melt(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], "variable", "value")


def rolling_median(df: DataFrame, column: str, half: int, by: By, within: By = (), name: str = "median") -> DataFrame:
    """The median of the rows from `half` before to `half` after."""
    w = Window.partitionBy(*within).orderBy(*by).rowsBetween(-half, half)
    return df.withColumn(name, F.expr(f"percentile({column}, 0.5)").over(w))


def rolling_line(df: DataFrame, x: str, y: str, half: int, by: By, within: By = ()) -> DataFrame:
    """slope and fitted: of the least-squares line through the rows from `half` before to `half` after; null where x does not
    vary."""
    w = Window.partitionBy(*within).orderBy(*by).rowsBetween(-half, half)
    slope, start = F.expr(f"regr_slope({y}, {x})").over(w), F.expr(f"regr_intercept({y}, {x})").over(w)
    return df.withColumns({"slope": slope, "fitted": start + slope * F.col(x)})


def join_by(left: DataFrame, right: DataFrame, equal: Mapping[str, str], conditions: Sequence[tuple[str, str, str]] = (), how: str = "inner") -> DataFrame:
    """A join on equal columns, by name left and right, and on conditions (left column, sign, right column) among rows that
    are equal there. Without equal columns it would be all pairs, and is refused."""
    if not equal:
        raise ValueError("a join needs equal columns; for ranges alone see skein.operators.asof.in_range")
    signs = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "!=": lambda a, b: a != b}
    on = [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in equal.items()] + [signs[s](F.col(f"l.{a}"), F.col(f"r.{b}")) for a, s, b in conditions]
    return left.alias("l").join(right.alias("r"), reduce(and_, on), how)


def sampled(df: DataFrame, fraction: float, key: str, seed: str = "") -> DataFrame:
    """The rows whose key's digest falls below a fraction: the same rows on every run, and of any larger fraction too."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.where(place < int(fraction * (1 << 32)))


def statistics(df: DataFrame, column: str, by: By = ()) -> DataFrame:
    """min, max, median, mean, std and total of a column."""
    c = F.col(column)
    return df.groupBy(*by).agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.percentile(c, F.lit(0.5)).alias("median"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.sum(c).alias("total")
    )
