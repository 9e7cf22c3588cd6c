"""Shapes and lattices."""

from math import inf

from hypothesis import given
from hypothesis import strategies as st

from skein.operators.lattice import NOTHING, Interval, Names, exactly, these
from skein.operators.shape import TOP, Shape, create, infer, join, loop, shape

INTERVALS = st.builds(Interval, st.integers(0, 9), st.one_of(st.integers(0, 9), st.just(inf)))
SETS = st.frozensets(st.sampled_from("abcd"))
NAMES = st.builds(lambda a, b: Names(a, None if b is None else a | b), SETS, st.one_of(st.none(), SETS))


@given(INTERVALS, INTERVALS)
def test_interval_laws(a, b):
    assert a <= a.join(b) and b <= a.join(b) and a.meet(b) <= a and a <= a.widen(b) and b <= a.widen(b)


@given(NAMES, NAMES)
def test_name_laws(a, b):
    assert a <= a.join(b) and b <= a.join(b) and a <= a.widen(b) and b <= a.widen(b)


def test_bottom():
    assert NOTHING.empty and NOTHING <= exactly(3) and (NOTHING + exactly(1)).empty and NOTHING.join(exactly(2)) == exactly(2)
    assert exactly(2).satisfies(2) is True and Interval(1, 3).satisfies(2) is None and Interval(1, 3).satisfies(5) is False


def test_steps_in_a_row():
    """A frame of 9 rows: a new column, rows named off, one column out, two frames on top of each other."""
    more = create(["when", "depth", "depth_cm"], 2)
    got = infer([("create", {"names": ["when", "where", "depth"], "rows": 9}), ("addCols", {"names": ["depth_cm"]}), ("removeRows", {"n": 4}), ("removeCols", {"names": ["where"]}), ("concatRows", {"other": more})])
    assert got.names == these(["when", "depth", "depth_cm"]) and got.rows == exactly(7) and got.cols == exactly(3)


def test_joins():
    a, b = shape(["k", "x"], 4), shape(["k", "y"], 6)
    assert join(a, b, ["k"]).rows == Interval(0, 6) and join(a, b, ["k"], "left").rows == Interval(4, 6) and join(a, b, ["k"], "right").rows == exactly(6)
    assert join(a, b, ["k"], "full").rows == Interval(6, 10) and join(a, b, []).rows == Interval(0, 24) and join(a, b, ["k"], sound=True).rows == Interval(0, 24)
    assert join(a, b, ["k"]).names == these(["k", "x", "y"]) and join(a, b, ["k"]).cols == exactly(3)
    assert join(a, b, None).names == Names() and "k" not in join(a, b, []).names.must


def test_operations():
    s = shape(["a", "b"], 3)
    run = lambda op, **args: infer([(op, args)], s)
    assert run("addCols", names=["c"]) == shape(["a", "b", "c"], 3)
    assert run("removeCols", names=["a"]) == shape(["b"], 3)
    assert run("removeCols", names=["a"], maybe=True).cols == Interval(1, 2)
    assert run("subsetCols", names=["a"]) == shape(["a"], 3)
    assert run("subsetRows", n=2).rows == exactly(2) and run("filterRows", condition=False).rows == exactly(0)
    assert run("addRows", n=2).rows == exactly(5) and run("removeRows", n=1).rows == exactly(2)
    assert run("summarize", names=["m"]).rows == Interval(1, 3) and run("groupBy", by=["a"]) == s
    assert run("setColNames", names=["x", "y"]) == shape(["x", "y"], 3) and run("setColNames", names=None).names == Names()
    assert run("accessCols", names=["z"]).names.must == {"a", "b", "z"} and run("accessRows", index=9).rows == exactly(9)
    assert run("concatCols", other=shape(["c"], 3)) == shape(["a", "b", "c"], 3) and run("concatRows", other=s).rows == exactly(6)
    assert run("unknown") == TOP and run("identity") == s and run("assignCols", names=["c"]).cols == Interval(2, 3)
    assert run("assignRows", index=7).rows == exactly(7) and run("mutateCols", names=["c"]).cols == Interval(2, 3)


def test_loops_settle():
    grow = lambda s: infer([("addRows", {"n": 1})], s)
    assert loop(grow, shape(["a"], 2)) == Shape(these(["a"]), exactly(1), Interval(2, inf))
