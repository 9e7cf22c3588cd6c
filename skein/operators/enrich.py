"""Enrichments of searches over a program: columns that say more about the nodes found.

    at = Search(program.nodes)
    call_targets(at.get(name="f"), program).frame
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.frontend.program import Program
from skein.operators import graph as G
from skein.operators.search import Search


def _joined(found: Search, more: DataFrame) -> Search:
    return found._with(found.frame.join(more, "node_id", "left"))


def call_targets(found: Search, p: Program, only_builtin: bool = False, qualified: bool = False) -> Search:
    """call_targets: the functions of the program that a call may go to, and the built-in ones' names; with `qualified`
    these with their package in front."""
    own = p.typed(G.CALLS, "node_id", "target").join(p.vertices.where("tag = 'function-definition'").select(F.col("id").alias("target")), "target", "left_semi").select("node_id", "target")
    name = F.when(F.col("ns").isNotNull(), F.concat("ns", F.lit("::"), "name")).otherwise(F.col("name")) if qualified else F.col("name")
    built_in = p.vertices.where("tag = 'function-call' and name is not null and exists(origin, x -> x like 'builtin:%')").select(F.col("id").alias("node_id"), name.alias("target"))
    rows = built_in.join(own.select("node_id"), "node_id", "left_anti") if only_builtin else own.union(built_in.join(own.select("node_id"), "node_id", "left_anti"))
    return _joined(found, rows.groupBy("node_id").agg(F.sort_array(F.collect_set("target")).alias("call_targets")))


def last_call(found: Search, p: Program, to: str, ignore: Column | None = None) -> Search:
    """last_call: on each way backward the nearest calls whose name matches `to`; calls for which `ignore` holds are passed."""
    from skein.operators.queries import link_to_last_call

    names = [r.name for r in found.frame.join(p.vertices.select(F.col("id").alias("node_id"), "name"), "node_id").select("name").distinct().where("name is not null").toLocalIterator()]
    links = link_to_last_call(p, "|".join(map(_quoted, names)) or "(?!)", to, ignore)
    return _joined(found, links.groupBy(F.col("id").alias("node_id")).agg(F.sort_array(F.collect_set("last")).alias("last_call")))


def _quoted(name: str) -> str:
    return "\\Q" + name.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def cfg_information(found: Search, p: Program) -> Search:
    """is_root: the node is a statement; is_reachable: its statement is reached."""
    dead = p.dead_code().select(F.col("id").alias("statement"), F.lit(True).alias("_dead"))
    flow = p.flow_edges().select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("_root", F.lit(True))
    of = p.nodes.select("node_id", "statement").join(dead, "statement", "left").join(flow, "node_id", "left")
    return _joined(found, of.select("node_id", F.coalesce("_root", F.lit(False)).alias("is_root"), F.col("_dead").isNull().alias("is_reachable")))


def roxygen(found: Search, p: Program) -> Search:
    """roxygen: the tags (tag, text) of the documentation that ends on the line above a node."""
    notes = p.nodes.where("type = 'RComment' and lexeme like '#\\'%'").select("file_id", "sl", F.regexp_replace("lexeme", r"^#'\s?", "").alias("text"))
    blocks = notes.withColumn("block", F.col("sl") - F.row_number().over(Window.partitionBy("file_id").orderBy("sl")))
    # a line that begins no tag goes on with the one above
    tag = F.regexp_extract("text", r"^@(\w+)", 1)
    w = Window.partitionBy("file_id", "block").orderBy("sl")
    parts = blocks.withColumn("tag", tag).withColumn("part", F.sum(F.when(F.col("tag") != "", 1).otherwise(0)).over(w)).withColumn("end", F.max("sl").over(Window.partitionBy("file_id", "block")))
    lines = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("sl", "text"))), lambda x: F.trim(F.regexp_replace(x["text"], r"^@\w+", ""))))
    tags = parts.groupBy("file_id", "end", "part").agg(F.max("tag").alias("tag"), F.trim(lines).alias("text"))
    named = tags.select("file_id", F.col("end"), F.when(F.col("tag") == "", "description").otherwise(F.col("tag")).alias("tag"), "text", "part")
    by = named.groupBy("file_id", "end").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "tag", "text"))), lambda x: F.struct(x["tag"].alias("tag"), x["text"].alias("text"))).alias("roxygen"))
    at = p.nodes.where("depth = 1").select("file_id", "node_id", (F.col("sl") - 1).alias("end")).join(by, ["file_id", "end"]).select("node_id", "roxygen")
    return _joined(found, at)


def query_data(found: Search, rows: DataFrame, key: str = "id") -> Search:
    """query_data: the rows of a query's result on each node, as JSON."""
    more = rows.select(F.col(key).alias("node_id"), F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != key])).alias("d"))
    return _joined(found, more.groupBy("node_id").agg(F.sort_array(F.collect_list("d")).alias("query_data")))
