"""Abstract domains: intervals, and sets of names known from below (must) and above (may).

Plain values serve the inference of one program; the Column forms at the end join many of them in aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """Whole numbers from lo to hi; empty is bottom."""

    lo: float = 0
    hi: float = inf

    @property
    def empty(self) -> bool:
        return self.lo > self.hi

    def __le__(self, other: Interval) -> bool:
        return self.empty or (other.lo <= self.lo and self.hi <= other.hi)

    def join(self, other: Interval) -> Interval:
        return other if self.empty else self if other.empty else Interval(min(self.lo, other.lo), max(self.hi, other.hi))

    def meet(self, other: Interval) -> Interval:
        return Interval(max(self.lo, other.lo), min(self.hi, other.hi))

    def widen(self, other: Interval) -> Interval:
        """Bounds that move give way entirely."""
        if self.empty or other.empty:
            return self.join(other)
        return Interval(self.lo if self.lo <= other.lo else 0, self.hi if self.hi >= other.hi else inf)

    def narrow(self, other: Interval) -> Interval:
        """Bounds that had given way come back."""
        if self.empty or other.empty:
            return NOTHING
        return Interval(other.lo if self.lo == 0 else self.lo, other.hi if self.hi == inf else self.hi)

    def _both(self, other: Interval, f) -> Interval:
        if self.empty or other.empty:
            return NOTHING
        out = f(self, other)
        return Interval(max(0, out[0]), max(0, out[1]))

    def __add__(self, other: Interval) -> Interval:
        return self._both(other, lambda a, b: (a.lo + b.lo, a.hi + b.hi))

    def less(self, low: float, high: float) -> Interval:
        """The lower bound less `low`, the upper bound less `high`."""
        return self if self.empty else Interval(max(0, self.lo - low), max(0, self.hi - high))

    def least(self, other: Interval) -> Interval:
        return self._both(other, lambda a, b: (min(a.lo, b.lo), min(a.hi, b.hi)))

    def most(self, other: Interval) -> Interval:
        return self._both(other, lambda a, b: (max(a.lo, b.lo), max(a.hi, b.hi)))

    def down(self) -> Interval:
        return self if self.empty else Interval(0, self.hi)

    def up(self) -> Interval:
        return self if self.empty else Interval(self.lo, inf)

    def satisfies(self, n: float) -> bool | None:
        """Whether the value is n: yes, maybe (None), no."""
        return False if not self.lo <= n <= self.hi else True if self.lo == self.hi else None


NOTHING = Interval(1, 0)


def exactly(n: int) -> Interval:
    return Interval(n, n)


@dataclass(frozen=True)
class Names:
    """Names that are there for sure, and those that may be (None: any)."""

    must: frozenset[str] = frozenset()
    may: frozenset[str] | None = None

    def __le__(self, other: Names) -> bool:
        return other.must <= self.must and (other.may is None or (self.may is not None and self.may <= other.may))

    def join(self, other: Names) -> Names:
        return Names(self.must & other.must, None if self.may is None or other.may is None else self.may | other.may)

    def meet(self, other: Names) -> Names:
        return Names(self.must | other.must, other.may if self.may is None else self.may if other.may is None else self.may & other.may)

    def union(self, other: Names) -> Names:
        return Names(self.must | other.must, None if self.may is None or other.may is None else self.may | other.may)

    def intersect(self, other: Names) -> Names:
        return Names(self.must & other.must, other.may if self.may is None else self.may if other.may is None else self.may & other.may)

    def subtract(self, other: Names) -> Names:
        """Names that are taken away for sure are gone; those that may be are no longer sure."""
        return Names(frozenset() if other.may is None else self.must - other.may, None if self.may is None else self.may - other.must)

    def widen(self, other: Names) -> Names:
        return Names(self.must if self.must <= other.must else frozenset(), self.may if self.may is not None and other.may is not None and other.may <= self.may else None)

    def down(self) -> Names:
        return Names(frozenset(), self.may)

    def up(self) -> Names:
        return Names(self.must, None)

    def satisfies(self, name: str) -> bool | None:
        return True if name in self.must else False if self.may is not None and name not in self.may else None


def these(names: list[str | None]) -> Names:
    """Just these names; a None among them stands for any."""
    known = frozenset(n for n in names if n is not None)
    return Names(known, None if None in names else known)


# aggregates over columns of intervals (lo, hi) and names (must, may; may null: any)


def joined_interval(lo: str = "lo", hi: str = "hi") -> list[Column]:
    return [F.min(lo).alias(lo), F.max(hi).alias(hi)]


def met_interval(lo: str = "lo", hi: str = "hi") -> list[Column]:
    return [F.max(lo).alias(lo), F.min(hi).alias(hi)]


def joined_names(must: str = "must", may: str = "may") -> list[Column]:
    every = F.collect_list(must)
    shared = F.aggregate(every, F.get(every, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    known = F.array_sort(F.array_distinct(F.flatten(F.collect_list(may))))
    return [F.array_sort(F.array_distinct(shared)).alias(must), F.when(F.count(F.when(F.col(may).isNull(), 1)) == 0, known).alias(may)]
