"""Fixpoints inside one file.

A file's graph came out of one task, so it fits one: reachability within files is one shuffle by file and a search in
memory, however long the ways are, where a fixpoint over tables takes a round for each step.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.frontend.shipping import ship

#: Kinds of steps: always taken; taken once two different vertices ask; no step, but an id that nothing goes on from.
ALWAYS, TWICE, STOP = 0, 1, 2


def reach(steps: dict[str, list[str]], start: Iterable[str], stops: Iterable[str] = ()) -> dict[str, int]:
    """The ids that the start reaches, with the fewest steps; nothing is entered beyond the stops."""
    depth = dict.fromkeys(start, 0)
    todo, stops = deque(depth), set(stops)
    while todo:
        x = todo.popleft()
        if x in stops:
            continue
        for y in steps.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    return depth


def slice_of(always: dict[str, list[str]], twice: dict[str, list[str]], start: Iterable[str]) -> dict[str, int]:
    """The slice of some ids: steps that need it are taken once two different vertices of the slice ask for their end."""
    depth = dict.fromkeys(start, 0)
    todo, asked = deque(depth), defaultdict(set)
    while todo:
        x = todo.popleft()
        found = list(always.get(x, ()))
        for y in twice.get(x, ()):
            asked[y].add(x)
            if len(asked[y]) == 2:
                found.append(y)
        for y in found:
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    return depth


def _by_root(seeds: pa.Table) -> dict[str, set[str]]:
    out: dict[str, set[str]] = defaultdict(set)
    for root, i in zip(seeds.column("root").to_pylist(), seeds.column("id").to_pylist(), strict=True):
        out[root].add(i)
    return out


def _run(search: Callable[[dict, dict, dict, set[str]], dict[str, int]]):
    schema = pa.schema([("file_id", pa.string()), ("root", pa.string()), ("id", pa.string()), ("depth", pa.int32())])

    def run(edges: pa.Table, seeds: pa.Table) -> pa.Table:
        kinds: tuple[dict, dict, dict] = (defaultdict(list), defaultdict(list), defaultdict(list))
        for src, dst, kind in zip(*(edges.column(c).to_pylist() for c in ("src", "dst", "kind")), strict=True):
            kinds[kind][src].append(dst)
        rows = []
        for root, ids in _by_root(seeds).items():
            rows += [(root, i, d) for i, d in search(*kinds, ids).items()]
        root, ids, depth = zip(*rows, strict=True) if rows else ((), (), ())
        file = seeds.column("file_id")[0].as_py() if seeds.num_rows else None
        return pa.Table.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(root, pa.string()), pa.array(ids, pa.string()), pa.array(depth, pa.int32())], schema=schema)

    return run


def _searched(edges: DataFrame, seeds: DataFrame, search: Callable[[dict, dict, dict, set[str]], dict[str, int]]) -> DataFrame:
    """edges (file_id, src, dst, kind), seeds (file_id, root, id): file_id, root, id, depth of what each root's seeds find."""
    ship(edges.sparkSession)
    left, right = _apart(edges).groupBy("file"), seeds.groupBy("file_id")
    return left.cogroup(right).applyInArrow(_run(search), "file_id string, root string, id string, depth int")


def _apart(edges: DataFrame) -> DataFrame:
    """edges with a file column of its own, since both sides of a cogroup may come from one table."""
    return edges.select(F.col("file_id").alias("file"), *[F.col(c).alias(c) for c in edges.columns if c != "file_id"])


def order_of(after: dict[str, list[str]], a: str, b: str, reached: set[str], before: dict[str, list[str]]) -> bool | None:
    """True if every way into b comes from a, None if some do, False if none does; `reached`: what a step or more after a
    can be."""
    if b not in reached:
        return False
    if a == b:
        return None
    # back from b without entering a: a beginning there is a way around
    seen, todo = {b}, [b]
    while todo:
        x = todo.pop()
        own = before.get(x, ())
        if not own:
            return None
        for y in own:
            if y != a and y not in seen:
                seen.add(y)
                todo.append(y)
    return True


def _ordered(flow: pa.Table, pairs: pa.Table) -> pa.Table:
    after: dict[str, list[str]] = defaultdict(list)
    before: dict[str, list[str]] = defaultdict(list)
    for src, dst in zip(flow.column("src").to_pylist(), flow.column("dst").to_pylist(), strict=True):
        after[src].append(dst)
        before[dst].append(src)
    a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
    reached = {x: set(reach(after, after.get(x, ()))) for x in set(a)}
    out = [order_of(after, x, y, reached[x], before) for x, y in zip(a, b, strict=True)]
    return pa.Table.from_arrays([pairs.column("file_id"), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(out, pa.bool_())], ["file_id", "a", "b", "before"])


def happens_before(flow: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (file_id, a, b) with `before`, as in skein.operators.graph.happens_before, along flow (file_id, src, dst)."""
    ship(flow.sparkSession)
    asked = pairs.select("file_id", "a", "b").distinct()
    steps = flow.select("file_id", "src", "dst").distinct().join(asked.select("file_id").distinct(), "file_id", "left_semi")
    return _apart(steps).groupBy("file").cogroup(asked.groupBy("file_id")).applyInArrow(_ordered, "file_id string, a string, b string, before boolean")


def closure(edges: DataFrame, seeds: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """What the seeds (file_id, root, id) reach along edges (file_id, src, dst): file_id, root, id, depth. Nothing is
    searched beyond the stops (file_id, id)."""
    steps = edges.select("file_id", "src", "dst").distinct().withColumn("kind", F.lit(ALWAYS))
    if stops is not None:
        steps = steps.unionByName(stops.select("file_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(STOP).alias("kind")).distinct())
    # files without seeds are not searched
    steps = steps.join(seeds.select("file_id").distinct(), "file_id", "left_semi")
    return _searched(steps, seeds.select("file_id", "root", "id").distinct(), lambda always, twice, stop, ids: reach(always, ids, stop))


def sliced(always: DataFrame, twice: DataFrame, criteria: DataFrame) -> DataFrame:
    """file_id, id of the slices for criteria (file_id, id): one slice for all criteria of a file."""
    steps = always.select("file_id", "src", "dst").distinct().withColumn("kind", F.lit(ALWAYS)).unionByName(twice.select("file_id", "src", "dst").distinct().withColumn("kind", F.lit(TWICE)))
    steps = steps.join(criteria.select("file_id").distinct(), "file_id", "left_semi")
    seeds = criteria.select("file_id", F.lit("slice").alias("root"), "id").distinct()
    return _searched(steps, seeds, lambda always, twice, stop, ids: slice_of(always, twice, ids)).select("file_id", "id")
