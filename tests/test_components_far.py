"""Components whose ends are further apart than the eight passes of the query's SQL."""

from skein.plans import catalog


def test_ends_beyond_eight_steps(spark, tmp_path):
    """Orders n and n + 1 share part n, for 30 orders; a last order stands alone with its part."""
    lines = [(n, n + k, 1_000 + n) for n in range(30) for k in (0, 1)] + [(90, 90, 1_090)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(n, 0 if n == 0 else 500 + n) for n in (*range(30), 90)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.component for r in catalog.queries()["components"](spark, str(tmp_path)).collect()}
    alone = {"o:90", "p:90", "s:1090", "c:590"}
    assert len(got) == 30 + 31 + 30 + 30 + 4
    assert {c for x, c in got.items() if x not in alone} == {"c:0"} and {got[x] for x in alone} == {"c:590"}
