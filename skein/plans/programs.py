"""Queries over programs: small scripts written from the star schema, parsed and analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.frontend.program import Program
from skein.plans.registry import query
from skein.session import table


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """One script for each nation: it sums some numbers; those of odd nations draw one without a seed."""
    n = table(spark, d, "nation")
    key, name = F.col("n_nationkey").cast("string"), F.regexp_replace(F.lower("n_name"), "[^a-z]", "_")
    odd = F.when(F.col("n_nationkey") % 2 == 1, F.lit("extra <- rnorm(1)\n")).otherwise(F.lit("set.seed(1)\nextra <- rnorm(1)\n"))
    code = F.concat(name, F.lit(" <- "), key, F.lit("\nunused <- 1\ntotal <- 0\nfor (i in 1:"), key, F.lit(") {\n  total <- total + "), name, F.lit("\n}\n"), odd, F.lit("print(total + extra)\n"))
    return n.select(F.concat(F.lit("n"), key).alias("file_id"), code.alias("content"))


@query("SELECT type, count(*) * m AS n FROM (VALUES ('RForLoop', 1), ('RFunctionCall', 2)) t(type, m), nation GROUP BY type, m ORDER BY 1")
def program_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Loops, and calls other than set.seed, of all scripts."""
    nodes = Program(scripts(spark, d)).nodes.where("type in ('RForLoop', 'RFunctionCall') and lexeme <> 'set.seed'")
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT 'n' || n_nationkey AS file_id, line FROM nation, (VALUES (1), (3), (4), (5), (6)) t(line)")
def program_slice(spark: SparkSession, d: str) -> DataFrame:
    """What the sum in the loop depends on, in every script."""
    p = Program(scripts(spark, d))
    return p.lines(p.slice("5@[1]total")).select("file_id", "line")


@query("SELECT 'n' || n_nationkey AS file_id, name FROM nation, (VALUES ('unused'), ('i')) t(name)")
def program_unused(spark: SparkSession, d: str) -> DataFrame:
    return Program(scripts(spark, d)).unused_definitions().select("file_id", "name")


@query("SELECT 'n' || n_nationkey AS file_id FROM nation WHERE n_nationkey % 2 = 1")
def program_unseeded(spark: SparkSession, d: str) -> DataFrame:
    return Program(scripts(spark, d)).unseeded().select("file_id")
