"""Source ranges: start line, start column, end line, end column, all counted from 1, ends included."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Range(NamedTuple):
    sl: Column
    sc: Column
    el: Column
    ec: Column


def columns(prefix: str = "") -> Range:
    return Range(*[F.col(prefix + c) for c in ("sl", "sc", "el", "ec")])


def _before(l1: Column, c1: Column, l2: Column, c2: Column, same: bool = False) -> Column:
    return (l1 < l2) | ((l1 == l2) & ((c1 <= c2) if same else (c1 < c2)))


def starts_before(a: Range, b: Range) -> Column:
    """a ends before b starts."""
    return _before(a.el, a.ec, b.sl, b.sc)


def overlap(a: Range, b: Range) -> Column:
    return _before(a.sl, a.sc, b.el, b.ec, True) & _before(b.sl, b.sc, a.el, a.ec, True)


def contains(a: Range, line: Column, column: Column) -> Column:
    return _before(a.sl, a.sc, line, column, True) & _before(line, column, a.el, a.ec, True)


def is_subset(a: Range, b: Range) -> Column:
    """a lies inside b."""
    return _before(b.sl, b.sc, a.sl, a.sc, True) & _before(a.el, a.ec, b.el, b.ec, True)


def is_strict_subset(a: Range, b: Range) -> Column:
    return is_subset(a, b) & ~((a.sl == b.sl) & (a.sc == b.sc) & (a.el == b.el) & (a.ec == b.ec))


def compare(a: Range, b: Range) -> Column:
    """Below, at or above 0: by start line, then start column."""
    return F.when(a.sl != b.sl, a.sl - b.sl).otherwise(a.sc - b.sc)


def merged(r: Range) -> list[Column]:
    """Aggregates: the range from a group's first start to its last end."""
    start, end = F.min(F.struct(r.sl, r.sc)), F.max(F.struct(r.el, r.ec))
    return [start["sl"].alias("sl"), start["sc"].alias("sc"), end["el"].alias("el"), end["ec"].alias("ec")]


def text(r: Range) -> Column:
    """line.column, or line.column-line.column where the ends differ."""
    one = (r.sl == r.el) & (r.sc == r.ec)
    start, end = F.concat(r.sl, F.lit("."), r.sc), F.concat(r.el, F.lit("."), r.ec)
    return F.when(one, start).otherwise(F.concat(start, F.lit("-"), end))
