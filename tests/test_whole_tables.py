"""Queries take whole tables: rows with large ids count as well as those with small ones."""

import datetime
import math

import pytest

from skein.plans import catalog

DAY = datetime.datetime(2020, 1, 1)


def run(spark, name, d):
    return {tuple(r) for r in catalog.queries()[name](spark, str(d)).collect()}


@pytest.fixture(scope="module")
def flows(spark, tmp_path_factory):
    """Three events of each of users 38 to 45 and one of user 1,000,000: the folder, and events by user in order."""
    d = tmp_path_factory.mktemp("flows")
    rows = [(10 * u + i, DAY + datetime.timedelta(hours=i), u, "view" if i == u % 2 else "click") for u in range(38, 46) for i in range(3)]
    rows.append((5, DAY, 1_000_000, "view"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{d}/events.parquet")
    return d, {u: [r for r in rows if r[2] == u] for u in {r[2] for r in rows}}


COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus".split()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Lines of orders and parts with small and large numbers: the folder, and the rows as dicts."""
    d = tmp_path_factory.mktemp("lines")
    kinds = [("R", "O", 1), ("N", "O", 1), ("R", "F", 1), ("R", "O", 2), ("N", "F", 2)]
    rows = [(3_999 + 1_000 * k, p, n, n, 3.0 * n, 0.01 * k, 0.02 * n, flag, status) for k, p in enumerate((1, 299, 300, 5_000, 70_000)) for flag, status, n in kinds[k % 2 * 2 :]]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/lineitem.parquet")
    return d, [dict(zip(COLUMNS, r, strict=True)) for r in rows]


def test_event_flows_of_every_user(spark, flows):
    d, of = flows
    chains = [[f"e:{r[0]}" for r in rows] for rows in of.values() if len(rows) > 1]
    assert run(spark, "basic_blocks", d) == {(x, c[0]) for c in chains for x in c}
    assert run(spark, "exit_points", d) == {(c[-1],) for c in chains}
    first = {u: next(i for i, r in enumerate(rows) if r[3] == "view") for u, rows in of.items()}
    assert run(spark, "happens_before", d) == {(f"e:{rows[first[u]][0]}", f"e:{rows[-1][0]}", True) for u, rows in of.items() if first[u] < len(rows) - 1}


def test_survivors_of_every_part(spark, lines):
    d, rows = lines
    kinds = lambda flag, part=None: {r["l_linestatus"] for r in rows if r["l_returnflag"] == flag and part in (None, r["l_partkey"])}
    pairs = {(r["l_returnflag"], r["l_partkey"]) for r in rows}
    want = {(flag, part) for flag, part in pairs if kinds(flag, part) == kinds(flag)}
    assert any(part >= 300 for _, part in want)
    assert run(spark, "survivor_intersect", d) == want


def test_scalars_of_every_line(spark, lines):
    d, rows = lines
    got = catalog.queries()["scalar_math_arithmetic"](spark, str(d)).select("l_orderkey", "l_linenumber", "add").collect()
    assert sorted(map(tuple, got)) == sorted((r["l_orderkey"], r["l_linenumber"], round(r["l_quantity"] + r["l_tax"], 6)) for r in rows)
    got = catalog.queries()["scalar_math_trigonometry"](spark, str(d)).select("l_orderkey", "l_linenumber", "s").collect()
    assert sorted(map(tuple, got)) == sorted((r["l_orderkey"], r["l_linenumber"], round(math.sin(r["l_quantity"]), 6)) for r in rows)


def test_branches_of_every_part(spark, lines):
    d, rows = lines
    whens = {}
    for r in rows:
        whens.setdefault(r["l_partkey"], {}).setdefault(r["l_suppkey"] % 4, set()).add(r["l_returnflag"] == "R")
    assert run(spark, "lint_branch_coverage", d) == {(k, all(len(x) == 2 for x in ids.values())) for k, ids in whens.items()}
