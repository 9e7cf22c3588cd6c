"""Shapes against real frames, and lattices in aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import lattice, shape
from skein.operators import verbs as V
from skein.plans.registry import query
from skein.session import table


@query("SELECT unnest(['create', 'filterRows', 'mutateCols', 'join', 'summarize', 'subsetRows']) AS step, true AS holds")
def shape_bounds_check(spark: SparkSession, d: str) -> DataFrame:
    """Each step's inferred shape holds the frame that the same verb makes."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n, m = o.count(), c.count()
    s, frame, out = shape.create(o.columns, n), o, []

    def step(name: str, inferred: shape.Shape, real: DataFrame) -> tuple[shape.Shape, DataFrame]:
        out.append((name, inferred.holds(real.columns, real.count())))
        return inferred, real

    s, frame = step("create", s, frame)
    s, frame = step("filterRows", shape.filter_rows(s), V.subset(frame, "o_totalprice > 50000"))
    s, frame = step("mutateCols", shape.mutate_cols(s, ["net"]), V.mutate(frame, net=F.col("o_totalprice") * 2))
    s, frame = step("join", shape.join(s, shape.create(c.columns, m), ["o_custkey"], "left"), V.join(frame, c, ["o_custkey"], "left"))
    step("summarize", shape.summarize(s, ["n"]), V.summarise(frame, ["o_orderstatus"], n=F.count("*")))
    step("subsetRows", shape.subset_rows(s, 5), V.head(frame, 5, ["o_orderkey"]))
    return spark.createDataFrame(out, "step string, holds boolean")


@query("SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1")
def lattice_interval_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.col("p_size").alias("lo"), F.col("p_size").alias("hi"))
    return rows.groupBy("p_brand").agg(*lattice.joined_interval())


@query(
    """WITH e AS (SELECT user_id, event_type FROM events), c AS (SELECT user_id, count(DISTINCT event_type) AS k, min(event_type) AS one FROM e GROUP BY 1)
    SELECT user_id, CASE WHEN k = 1 THEN one ELSE '' END AS must, k AS n_may FROM c"""
)
def lattice_names_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.array("event_type").alias("must"), F.array("event_type").alias("may"))
    out = e.groupBy("user_id").agg(*lattice.joined_names())
    return out.select("user_id", F.concat_ws(",", "must").alias("must"), F.size("may").cast("long").alias("n_may"))
