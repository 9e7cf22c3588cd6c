"""Queries over programs by name: each takes a Program and its arguments and returns a DataFrame.

run() evaluates several at once; one that fails gives an error and does not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.frontend import local
from skein.frontend.program import Program, constant_of
from skein.operators import graph as G
from skein.operators import search as S

#: Functions that load, run, read, write, draw, test or handle files, by category.
DEPENDENCIES = {
    "library": ("library", "require", "loadNamespace", "requireNamespace", "attachNamespace", "p_load", "use", "pkg_attach", "needs", "shelf", "load_all"),
    "source": ("source", "sys.source", "source_url", "source_gist"),
    "read": ("read.table", "read.csv", "read.csv2", "read.delim", "read.delim2", "read.dcf", "read.fwf", "read_csv", "read_csv2", "read_tsv", "read_delim", "read_lines", "read_rds", "readRDS", "readLines", "load", "fread", "read_excel", "read.xlsx", "read_feather", "read_parquet", "scan", "file", "url", "gzfile", "download.file", "read_fwf", "read_sas", "read_dta", "read_xml", "read_html", "fromJSON"),
    "write": ("write.csv", "write.csv2", "write.table", "write_csv", "write_csv2", "write_tsv", "write_delim", "write_rds", "saveRDS", "save", "save.image", "dump", "sink", "writeLines", "write_lines", "write_file", "fwrite", "write_feather", "write_parquet", "print", "cat", "message", "warning"),
    "visualize": ("plot", "hist", "barplot", "boxplot", "lines", "points", "abline", "curve", "pie", "ggplot", "geom_point", "geom_line", "ggsave", "pdf", "png", "jpeg", "svg", "tiff"),
    "test": ("test_that", "describe", "it", "test_file", "test_dir", "test_package", "test_all", "expect_equal", "expect_true", "runTestFile", "runTestSuite"),
    "remote": ("install_github", "install_gitlab", "install_bitbucket", "install_git", "install_svn", "install_url", "install_bioc", "pkg_install", "pak"),
    "other-path": ("setwd", "basename", "dirname", "normalizePath", "file.info", "file.size", "file.create", "file.exists", "file.remove", "file.rename", "file.append", "file.copy", "dir.exists", "list.files", "list.dirs", "dir"),
    "statistics": ("lm", "glm", "aov", "t.test", "wilcox.test", "chisq.test", "cor", "cor.test", "anova", "predict", "prcomp", "kmeans", "shapiro.test", "nls"),
}
#: Calls whose results come from outside, by the kind of what they bring in.
INPUTS = {
    "file": DEPENDENCIES["read"], "tempfile": ("tempfile", "tempdir"), "glob": ("list.files", "list.dirs", "dir", "Sys.glob"), "net": ("GET", "POST", "curl", "getURL"),
    "rand": ("rnorm", "runif", "sample", "rbinom", "rexp", "rpois"), "system": ("system", "system2", "shell", "Sys.time", "Sys.Date"), "ffi": (".C", ".Call", ".Fortran", ".External"),
    "options": ("getOption", "Sys.getenv"), "cmdline": ("commandArgs",), "user": ("readline", "menu", "file.choose"),
}
QUOTED = ("quote", "bquote", "substitute", "expression")

Query = Callable[..., DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def run(program: Program, requests: Sequence[Mapping[str, Any]]) -> list[DataFrame | Exception]:
    """The results of requests {"type": name, ...arguments}, in order. A compound request {"type": "compound", "query",
    "common", "arguments": [...]} stands for several, whose own arguments win over the common ones."""
    todo: list[dict[str, Any]] = []
    for r in requests:
        if r["type"] == "compound":
            todo += [{"type": r["query"], **r.get("common", {}), **own} for own in r["arguments"]]
        else:
            todo.append(dict(r))
    out: list[DataFrame | Exception] = []
    for r in todo:
        try:
            out.append(QUERIES[r.pop("type")](program, **r))
        except Exception as x:  # noqa: BLE001 - one failing query must not stop the others
            out.append(x)
    return out


@query("dataflow")
def dataflow(p: Program) -> DataFrame:
    return p.data_edges().withColumn("names", G.type_names(F.col("types")))


@query("dataflow-lens")
def dataflow_lens(p: Program) -> DataFrame:
    """The data flow without values, operators and keywords."""
    plain = F.col("name").rlike(r"^[A-Za-z.][\w.]*$") & ~F.col("name").isin("if", "for", "while", "repeat", "function", "break", "next")
    kept = p.vertices.where((F.col("tag") != "value") & (F.col("tag").isin("function-definition") | plain))
    return G.induced(p.data_edges(), kept.select("id"))


@query("normalized-ast")
def normalized_ast(p: Program) -> DataFrame:
    return p.nodes


@query("id-map")
def id_map(p: Program) -> DataFrame:
    return p.nodes.select("node_id", "file_id", "type", "lexeme")


@query("location-map")
def location_map(p: Program, ids: Sequence[str] | None = None, span: str = "full") -> DataFrame:
    """Places of nodes: of all of a node (full), of its first line's token (token), or of its statement."""
    out = p.nodes if ids is None else p.nodes.where(F.col("node_id").isin(list(ids)))
    if span == "statement":
        whole = p.nodes.select(F.col("node_id").alias("statement"), "sl", "sc", "el", "ec")
        return out.select("node_id", "file_id", "statement").join(whole, "statement").select("node_id", "file_id", "sl", "sc", "el", "ec")
    if span == "token":
        width = F.col("sc") + F.length("lexeme") - 1
        return out.select("node_id", "file_id", "sl", "sc", F.col("sl").alias("el"), F.when(F.col("sl") == F.col("el"), F.least(width, F.col("ec"))).otherwise(width).alias("ec"))
    return out.select("node_id", "file_id", "sl", "sc", "el", "ec")


@query("control-flow")
def control_flow(p: Program, blocks: bool = False, passes: Sequence[str] = ()) -> DataFrame:
    """src, dst of the flow after simplification passes in order: `unique-cf-sets` (each edge once), `remove-dead-code` (only
    what the beginnings reach); with `blocks`, the basic blocks of it."""
    flow = p.flow_edges().select("file_id", "src", "dst")
    for name in passes:
        if name == "unique-cf-sets":
            flow = flow.distinct()
        elif name in ("remove-dead-code", "analyze-dead-code"):
            dead = p.dead_code().select("id")
            flow = flow.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
        elif name == "to-basic-blocks":
            blocks = True
        else:
            raise ValueError(f"no pass {name!r}")
    return G.basic_blocks(flow) if blocks else flow.select("src", "dst")


@query("dataflow-cluster")
def cluster(p: Program) -> DataFrame:
    """id, component, has_unknown_side_effects over data edges; what calls pass on from a block is its value alone."""
    found = G.clusters(p.vertices, p.data_edges())
    effects = found.join(p.unknown_effects.select("id"), "id", "left_semi").select("component").distinct().withColumn("has_unknown_side_effects", F.lit(True))
    return found.join(effects, "component", "left").select("id", "component", F.coalesce("has_unknown_side_effects", F.lit(False)).alias("has_unknown_side_effects"))


def _unquoted_calls(p: Program) -> DataFrame:
    quoted = p.edges.where(G.includes(F.col("types"), G.NSE)).select(F.col("dst").alias("id"))
    return p.calls().join(quoted, "id", "left_anti")


def _targeted(p: Program, calls: DataFrame, targets: str) -> DataFrame:
    """Calls by where they may go: functions of the program (local), only such (must-local), none (must-global), or what is
    not surely one (global: no definition of the name holds whatever branches were taken)."""
    if targets == "any":
        return calls
    own = p.typed(G.CALLS, "id", "target").select("id").distinct().withColumn("_local", F.lit(True))
    defined = p.vertices.where("tag = 'variable-definition'").select(F.col("id").alias("d"), (F.size("cds") == 0).alias("always"))
    sure = p.typed(G.READS, "id", "d").join(defined, "d").groupBy("id").agg(F.bool_or("always").alias("_sure"))
    out = calls.join(own, "id", "left").join(sure, "id", "left")
    local, surely = F.coalesce("_local", F.lit(False)), F.coalesce("_sure", F.lit(False))
    wanted = {"local": local, "must-local": local & surely, "must-global": ~local, "global": ~local | ~surely}
    if targets not in wanted:
        raise ValueError(f"no call targets {targets!r}")
    return out.where(wanted[targets]).drop("_local", "_sure")


def _value_steps(p: Program) -> DataFrame:
    """file_id, src, dst: from a vertex to those whose value it has: of a use its definitions, of a definition what it is
    given, of a call what it returns."""
    plain = p.vertices.where("tag in ('use', 'variable-definition')").select(F.col("id").alias("src"))
    passed = p.typed(G.READS | G.DEFINED_BY).join(plain, "src", "left_semi").select("file_id", "src", "dst")
    return passed.union(p.typed(G.RETURNS)).distinct()


def _aliases(p: Program, calls: DataFrame) -> DataFrame:
    """id, alias, root: the names of functions that a called name may stand for, along reads, definitions and returns."""
    steps = _value_steps(p)
    named = p.vertices.where("tag = 'variable-definition'").select(F.col("id").alias("d"), F.col("name").alias("n"))
    first = calls.select("file_id", F.col("id").alias("root"), "name").join(p.typed(G.READS, "root", "d"), ["file_id", "root"]).join(named, "d").where("name = n").select("file_id", "root", F.col("d").alias("id"))
    uses = p.vertices.where("tag = 'use'").select("id", F.col("name").alias("alias"))
    return local.closure(steps, first).join(uses, "id").select(F.col("root").alias("id"), "alias", F.col("id").alias("alias_root"))


@query("call-context")
def call_context(
    p: Program, patterns: Sequence[tuple[str, str, str]], exact: bool = False, targets: str = "any", files: str | None = None, aliases: bool = False, package: str | None = None,
    link_to: str | None = None, nested: str | None = None,
) -> DataFrame:
    """kind, subkind, id, name of calls whose names match: patterns (kind, subkind, name or regular expression).

    targets: see _targeted. With aliases, calls of names that stand for a matching one count too, and alias_root says
    which use gave the name. package: calls with this package in front, or with none. link_to: a column `linked` with the
    last calls of that name before, on each way; nested: with those inside the call. Calls inside quotes are left out.
    """
    table = p.rows.sparkSession.createDataFrame([(k, s, n, exact) for k, s, n in patterns], "kind string, subkind string, pattern string, exact boolean")
    calls = _targeted(p, _unquoted_calls(p), targets)
    if files is not None:
        calls = calls.where(F.col("file_id").rlike(files))
    if package is not None:
        calls = calls.where(F.col("ns").isNull() | (F.col("ns") == package))
    calls = calls.select("id", "file_id", "name", "sl", "sc")
    if aliases:
        more = calls.join(_aliases(p, calls), "id")
        both = calls.withColumn("alias", F.col("name")).withColumn("alias_root", F.lit(None).cast("string")).unionByName(more)
        out = S.two_layers(both, table, "alias").drop("alias")
    else:
        out = S.two_layers(calls, table)
    for name, links in (("linked", link_to and link_to_last_call(p, ".*", link_to, start=out)), ("nested", nested and link_to_nested_call(p, nested))):
        if links:
            of = links.groupBy("id").agg(F.sort_array(F.collect_set(links.columns[1])).alias(name))
            out = out.join(of, "id", "left")
    return out


@query("link-to-last-call")
def link_to_last_call(p: Program, call: str, to: str, ignore: Any = None, go_on: Any = None, start: DataFrame | None = None) -> DataFrame:
    """id, last: for calls named `call` (or those of `start`) the last ones named `to` before them, along flow edges
    backward: on each way the nearest. Calls for which the column `ignore` holds are passed over; the search goes on beyond
    those for which `go_on` holds."""
    calls = p.calls()
    goals = calls.where(F.col("name").rlike(f"^(?:{to})$"))
    if ignore is not None:
        goals = goals.where(~ignore)
    goal = goals.select("file_id", F.col("statement").alias("hit"), F.col("id").alias("last"), (go_on if go_on is not None else F.lit(False)).alias("on"))
    begin = calls.where(F.col("name").rlike(f"^(?:{call})$")) if start is None else calls.join(start.select("id").distinct(), "id", "left_semi")
    back = p.flow_edges().select("file_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    first = begin.select("file_id", F.col("id").alias("root"), F.col("statement").alias("src")).join(back, ["file_id", "src"]).select("file_id", "root", F.col("dst").alias("id"))
    reached = local.closure(back, first, stops=goal.where("not on").select("file_id", F.col("hit").alias("id")))
    return reached.join(goal, (reached["file_id"] == goal["file_id"]) & (F.col("id") == F.col("hit"))).select(F.col("root").alias("id"), "last").distinct()


@query("link-to-nested-call")
def link_to_nested_call(p: Program, to: str, ignore: Any = None) -> DataFrame:
    """id, inner: for each call the calls named `to` inside it."""
    inner = p.calls().where(F.col("name").rlike(f"^(?:{to})$"))
    if ignore is not None:
        inner = inner.where(~ignore)
    up = p.nodes.where("parent_id is not null").select("file_id", F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
    above = local.closure(up, inner.select("file_id", F.col("id").alias("root"), "id")).where("depth > 0").select("id", F.col("root").alias("inner"))
    return above.join(p.calls().select("id"), "id", "left_semi")


@query("call-graph")
def call_graph(p: Program, unreachable: bool = True, db: Any = None) -> DataFrame:
    """Edges between functions; with a signature database also from functions to the packages' functions that they call
    (`package::name`)."""
    out = p.call_graph(unreachable).select("src", "dst", "types")
    if db is None:
        return out
    calls = p.calls().where("ns is not null").select(F.coalesce("owner", F.concat("file_id", F.lit(":top"))).alias("src"), F.col("ns").alias("pkg"), "name")
    known = calls.join(db.fn.select("pkg", "name").distinct(), ["pkg", "name"], "left_semi")
    return out.unionByName(known.select("src", F.concat("pkg", F.lit("::"), "name").alias("dst"), F.lit(G.CALLS).alias("types")).distinct())


def _file_of(id: Any) -> Any:
    """The file of an id, `file:number`."""
    return F.regexp_replace(id, ":[^:]*$", "")


@query("does-call")
def does_call(p: Program, call: str, names: Sequence[str], every: bool = False) -> DataFrame:
    """id, calls: whether functions bound to the name `call` call, directly or not, any (or every) of the names."""
    holders = p.vertices.where(F.col("name") == call).where("tag = 'variable-definition'").select(F.col("id").alias("src"))
    held = p.typed(G.DEFINED_BY).join(holders, "src", "left_semi").select(F.col("dst").alias("id"))
    roots = p.vertices.where("tag = 'function-definition'").join(held, "id", "left_semi").select("file_id", F.col("id").alias("root"), "id")
    functions = local.closure(p.call_graph(), roots).select("root", F.col("id").alias("owner"))
    inside = p.calls().select("owner", "name").join(functions, "owner").select("root", "name")
    hits = inside.where(F.col("name").isin(list(names))).groupBy("root").agg(F.countDistinct("name").alias("n"))
    need = len(set(names)) if every else 1
    return roots.select(F.col("root").alias("id")).distinct().join(hits.withColumnRenamed("root", "id"), "id", "left").select("id", (F.coalesce("n", F.lit(0)) >= need).alias("calls"))


@query("static-slice")
def static_slice(p: Program, criteria: Sequence[str], direction: str = "backward", code: bool = False, callees: bool = False) -> DataFrame:
    """file_id, id of the slice; with code, file_id and the code of it."""
    ids = p.slice(*criteria, forward=direction == "forward", callees=callees)
    return p.code(ids) if code else ids


@query("dice")
def dice(p: Program, start: Sequence[str], end: Sequence[str]) -> DataFrame:
    """id: what lies on the ways from start to end, within files."""
    edges = p.data_edges().select("file_id", "src", "dst")
    seeds = lambda *c: p.criterion(*c).select("file_id", F.lit("dice").alias("root"), "id")
    back = local.closure(edges, seeds(*end)).select("file_id", "id")
    forward = local.closure(edges.select("file_id", F.col("dst").alias("src"), F.col("src").alias("dst")), seeds(*start)).select("file_id", "id")
    return back.intersect(forward).select("id")


@query("provenance")
def provenance(p: Program, criteria: Sequence[str], within_function: bool = False) -> DataFrame:
    """id: what the criteria's values come from, with what controls it; within the function around each, if wanted."""
    ids = p.criterion(*criteria)
    edges = p.data_edges().where(G.includes(F.col("types"), G.FOLLOWED)).select("file_id", "src", "dst")
    edges = edges.union(p.vertices.select("file_id", F.col("id").alias("src"), F.explode("cds").alias("dst")))
    found = local.closure(edges, ids.select("file_id", F.col("id").alias("root"), "id"))
    if within_function:
        owner = p.nodes.select(F.col("node_id").alias("id"), F.coalesce("owner", F.lit("")).alias("owner"))
        asked = owner.withColumnRenamed("id", "root").withColumnRenamed("owner", "of")
        found = found.join(owner, "id").join(asked, "root").where("owner = of")
    return found.select("id").distinct()


@query("origin")
def origin(p: Program, criteria: Sequence[str]) -> DataFrame:
    ids = p.criterion(*criteria).select("id")
    return G.origins(p.vertices, p.data_edges()).join(ids, "id", "left_semi")


@query("symbol-references")
def symbol_references(p: Program, criteria: Sequence[str]) -> DataFrame:
    """id, reference: all vertices that stand for the same variable as a criterion: its definitions and what reads them."""
    ids = p.criterion(*criteria).select("file_id", F.col("id").alias("root"))
    names = p.vertices.select(F.col("id").alias("root"), "name", "tag")
    own = ids.join(names, "root")
    reads = p.typed(G.READS, "use", "definition").join(p.vertices.where("tag = 'variable-definition'").select(F.col("id").alias("definition"), F.col("name").alias("of")), "definition")
    reads = reads.join(p.vertices.select(F.col("id").alias("use"), F.col("name").alias("by")), "use").where("of = by").select("file_id", "use", "definition")
    both = reads.select("file_id", F.col("use").alias("src"), F.col("definition").alias("dst")).union(reads.select("file_id", "definition", "use"))
    found = local.closure(both, own.select("file_id", "root", F.col("root").alias("id")))
    return found.select(F.col("root").alias("id"), F.col("id").alias("reference"))


@query("happens-before")
def happens_before(p: Program, a: str, b: str) -> DataFrame:
    """file_id, a, b, before: for the statements of two criteria in each file."""
    at = p.statement_of()
    one, two = (p.criterion(c).join(at, ["file_id", "id"]).select("file_id", "statement").distinct() for c in (a, b))
    pairs = one.select("file_id", F.col("statement").alias("a")).join(two.select("file_id", F.col("statement").alias("b")), "file_id")
    return local.happens_before(p.flow_edges(), pairs)


def _functions(p: Program, only: Sequence[str] | None) -> DataFrame:
    """id of the functions of the program, or of those that hold or are given by criteria."""
    functions = p.vertices.where("tag = 'function-definition'").select("id")
    if only is None:
        return functions
    at = p.criterion(*only).select("id")
    held = p.typed(G.DEFINED_BY, "id", "f").join(at, "id", "left_semi").select(F.col("f").alias("id"))
    around = p.nodes.select(F.col("node_id").alias("id"), "owner").join(at, "id", "left_semi").select(F.col("owner").alias("id"))
    return functions.join(at.union(held).union(around).distinct(), "id", "left_semi")


@query("inspect-recursion")
def inspect_recursion(p: Program, only: Sequence[str] | None = None) -> DataFrame:
    """id, recursive: whether a function may call itself, directly or not."""
    functions = _functions(p, only)
    graph = p.call_graph()
    first = graph.join(functions.withColumnRenamed("id", "src"), "src", "left_semi").select("file_id", F.col("src").alias("root"), F.col("dst").alias("id"))
    back = local.closure(graph, first).where("root = id").select("id").withColumn("recursive", F.lit(True)).distinct()
    return functions.join(back, "id", "left").withColumn("recursive", F.coalesce("recursive", F.lit(False)))


@query("inspect-exception")
def inspect_exception(p: Program, names: Sequence[str] = ("stop", "abort", "stopifnot"), only: Sequence[str] | None = None) -> DataFrame:
    """function, call, cds: calls that raise, in functions and in what they call, and what controls them; not those below
    try and tryCatch."""
    calls = p.calls()
    up = p.nodes.where("parent_id is not null").select("file_id", F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
    raising = calls.where(F.col("name").isin(list(names)) & F.col("owner").isNotNull())
    caught = calls.where("name in ('try', 'tryCatch')").select("id")
    under = local.closure(up, raising.select("file_id", F.col("id").alias("root"), "id")).join(caught, "id", "left_semi").select(F.col("root").alias("id"))
    free = raising.join(under, "id", "left_anti").select("owner", F.col("id").alias("call"), "branches")
    roots = _functions(p, only).join(p.vertices.select("file_id", "id"), "id").select("file_id", F.col("id").alias("root"), "id")
    reached = local.closure(p.call_graph(), roots).select(F.col("root").alias("function"), F.col("id").alias("owner"))
    return reached.join(free, "owner").select("function", "call", F.col("branches").alias("cds"))


@query("inspect-higher-order")
def inspect_higher_order(p: Program, only: Sequence[str] | None = None) -> DataFrame:
    """id, higher_order: whether a function returns a function or is given one."""
    functions = _functions(p, only)
    every = p.vertices.where("tag = 'function-definition'").select("id")
    # calls of it by its name or in place; a built-in that is given it is no call of its caller's
    own = p.vertices.where("tag = 'function-call' and exists(origin, x -> x in ('function', 'unnamed'))").select(F.col("id").alias("call"))
    calls = p.typed(G.CALLS, "call", "id").join(functions, "id", "left_semi").join(own, "call", "left_semi")
    values = _value_steps(p)
    given = p.typed(G.ARGUMENT, "call", "arg").select("call", "arg")
    held = local.closure(values, calls.join(given, "call").select("file_id", F.col("id").alias("root"), F.col("arg").alias("id"))).join(every, "id", "left_semi").select(F.col("root").alias("id"))
    exits = calls.join(p.typed(G.RETURNS, "call", "exit").select("call", "exit"), "call")
    back = local.closure(values, exits.select("file_id", F.col("id").alias("root"), F.col("exit").alias("id"))).join(every, "id", "left_semi").select(F.col("root").alias("id"))
    high = held.union(back).distinct().withColumn("higher_order", F.lit(True))
    return functions.join(high, "id", "left").withColumn("higher_order", F.coalesce("higher_order", F.lit(False)))


@query("dependencies")
def dependencies(p: Program, categories: Sequence[str] | None = None, more: Mapping[str, Sequence[str]] | None = None, defaults: bool = True) -> DataFrame:
    """category, file_id, id, name, value: what programs load, read, write, draw and test; value: what the first argument
    stands for, where that is one constant. A library's name may be a plain symbol."""
    known = {k: (*v, *(more or {}).get(k, ())) for k, v in (DEPENDENCIES if defaults else {}).items() if categories is None or k in categories}
    known |= {k: tuple(v) for k, v in (more or {}).items() if k not in known and (categories is None or k in categories or k not in DEPENDENCIES)}
    table = p.rows.sparkSession.createDataFrame([(k, n) for k, v in known.items() for n in v], "category string, name string")
    mine = p.typed(G.CALLS, "id", "target").select("id").distinct()
    calls = p.calls().join(mine, "id", "left_anti").join(F.broadcast(table), "name")
    args = p.nodes.where("role = 'call-argument'").select(F.col("node_id").alias("arg"), F.col("parent_id").alias("id"), "idx")
    value = p.nodes.where("role = 'arg-value'").select(F.col("parent_id").alias("arg"), F.col("node_id").alias("value_id"), "type", constant_of(F.col("value")).alias("symbol"))
    first = args.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("idx"))).where("r = 1").join(value, "arg").join(p.constants.select(F.col("id").alias("value_id"), "values"), "value_id", "left")
    out = calls.join(first.select("id", "type", "symbol", "values"), "id", "left")
    one = F.when(F.size("values") == 1, F.col("values")[0])
    value = F.when((F.col("category") == "library") & F.col("type").isin("RSymbol", "RString"), F.col("symbol")).otherwise(one)
    return out.select("category", "file_id", "id", "name", value.alias("value"))


@query("resolve-value")
def resolve_value(p: Program, criteria: Sequence[str]) -> DataFrame:
    """id, values: the constants that a vertex may stand for, folded; null where some of it is no constant."""
    return p.criterion(*criteria).select("id").join(p.constants.select("id", "values"), "id", "left")


@query("input-sources")
def input_sources(p: Program, criteria: Sequence[str]) -> DataFrame:
    """id, source, kind: where a value comes from: const, param, or the kind of the call that it comes from; unknown calls
    are unknown."""
    ids = p.criterion(*criteria).select("file_id", F.col("id").alias("root"), "id")
    edges = p.data_edges().where(G.includes(F.col("types"), G.FOLLOWED | G.DEFINED_BY_ON_CALL) & ~G.includes(F.col("types"), G.NSE))
    # a call of a known kind is a source itself: what it is given does not matter
    kinds = {n: k for k, names in INPUTS.items() for n in names}
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    calls = p.vertices.where("tag = 'function-call'").select("file_id", "id", known[F.col("name")].alias("call_kind"))
    reached = local.closure(edges, ids, stops=calls.where("call_kind is not null").select("file_id", "id"))
    params = p.nodes.where("role = 'param-name'").select(F.col("node_id").alias("id"), F.lit(True).alias("param"))
    of = reached.select("root", "id").join(p.vertices.select("id", "tag", "name", "origin"), "id").join(params, "id", "left").join(calls.select("id", "call_kind"), "id", "left")
    unknown = (F.col("tag") == "function-call") & (F.size("origin") == 0)
    kind = F.when(F.col("tag") == "value", "const").when(F.col("param"), "param").otherwise(F.coalesce("call_kind", F.when(unknown, F.lit("unknown"))))
    return of.withColumn("kind", kind).where("kind is not null").select(F.col("root").alias("id"), F.col("id").alias("source"), "kind").distinct()


def _documented(p: Program) -> DataFrame:
    """file_id, function, param, side: parameters that only the documentation above a function or only the function has."""
    from skein.operators.lint import missing

    notes = p.nodes.where("type = 'RComment' and lexeme like '#\\'%'").select("file_id", "sl", "lexeme")
    island = F.col("sl") - F.row_number().over(Window.partitionBy("file_id").orderBy("sl"))
    blocks = notes.withColumn("block", island)
    ends = blocks.groupBy("file_id", "block").agg(F.max("sl").alias("end"))
    named = F.regexp_extract("lexeme", r"^#'\s*@param\s+(\S+)", 1)
    tags = blocks.where(named != "").select("file_id", "block", F.explode(F.split(named, ",")).alias("param")).join(ends, ["file_id", "block"])
    functions = p.nodes.where("type = 'RFunctionDefinition'").select("file_id", F.col("node_id").alias("function"), F.col("sl").alias("line"))
    own = functions.join(tags, (functions["file_id"] == tags["file_id"]) & (F.col("line") == F.col("end") + 1)).select(functions["file_id"], "function", "param")
    names = p.nodes.where("role = 'param-name'").select(F.col("parent_id").alias("q"), F.col("lexeme").alias("param"))
    declared = p.nodes.where("role = 'function-def-param'").select("file_id", F.col("node_id").alias("q"), F.col("parent_id").alias("function")).join(names, "q")
    declared = declared.join(own.select("function").distinct(), "function", "left_semi").select("file_id", "function", "param")
    return missing(own, declared, ["file_id", "function"])


def _problematic(p: Program, names: Sequence[str] = ("eval", "system", "system2", "shell", "pipe")) -> DataFrame:
    """Calls whose inputs are more than constants: a parameter, a name without definition, or the result of a call."""
    calls = p.calls().where(F.col("name").isin(*names)).select("file_id", "id")
    plain = ("<-", "=", "->", "<<-", "c", "paste", "paste0", "(", "{", "if", "file.path", *QUOTED)
    inputs = p.typed(G.ARGUMENT, "root", "id").join(calls.select("file_id", F.col("id").alias("root")), ["file_id", "root"], "left_semi")
    steps = p.data_edges().where(G.includes(F.col("types"), G.FOLLOWED) & ~G.includes(F.col("types"), G.NSE))
    reached = local.closure(steps, inputs).select("root", "id")
    params = p.nodes.where("role = 'param-name'").select(F.col("node_id").alias("id"), F.lit(True).alias("param"))
    known = p.typed(G.READS, "id", "d").select("id", F.lit(True).alias("defined")).distinct()
    of = reached.join(p.vertices.select("id", "tag", "name"), "id").join(params, "id", "left").join(known, "id", "left")
    # what folds to constants is one, whatever calls it went through
    of = of.join(p.constants.select("id", "values"), "id", "left")
    open_ = (F.col("values").isNull() & (F.col("tag") == "function-call") & ~F.col("name").isin(*plain)) | F.col("param") | ((F.col("tag") == "use") & F.col("defined").isNull())
    return calls.join(of.where(open_).select(F.col("root").alias("id")).distinct(), "id", "left_semi")


def _stop_calls(p: Program) -> DataFrame:
    """Calls of stop() whose `call.` does not stand for FALSE."""
    calls = p.calls().where("name = 'stop' and not array_contains(origin, 'function')")
    flags = p.nodes.where("role = 'call-argument' and lexeme = 'call.'").select(F.col("node_id").alias("arg"), F.col("parent_id").alias("id"))
    value = p.nodes.where("role = 'arg-value'").select(F.col("parent_id").alias("arg"), F.col("node_id").alias("v"))
    off = flags.join(value, "arg").join(p.constants.select(F.col("id").alias("v"), "values"), "v").where(F.col("values") == F.array(F.lit("FALSE"))).select("id")
    return calls.join(off, "id", "left_anti").select("file_id", "id")


def _unclosed(p: Program, opens: Sequence[str] = ("file", "url", "gzfile", "bzfile", "xzfile", "fifo", "pipe", "socketConnection")) -> DataFrame:
    """file_id, id, certainty: connections that are opened and held by a name, and not closed by that name on all ways.
    Certain without any close; uncertain where closes stand in some branches only."""
    from skein.operators.lint import every_branch

    calls = p.calls()
    opened = calls.where(F.col("name").isin(*opens)).select("file_id", "id", F.col("branches").alias("mine"))
    held = p.typed(G.DEFINED_BY, "d", "id").join(opened.select("id"), "id", "left_semi").join(p.vertices.where("tag = 'variable-definition'").select(F.col("id").alias("d")), "d", "left_semi").select("id", "d")
    used = p.typed(G.READS, "use", "d").select("use", "d")
    closing = calls.where("name = 'close'").select(F.col("id").alias("close"), "branches").join(p.typed(G.ARGUMENT, "close", "use").select("close", "use"), "close")
    pairs = held.join(used, "d").join(closing, "use").join(opened.select("id", "mine"), "id").select("id", "close", F.array_except("branches", "mine").alias("left"))
    sure = pairs.where(F.size("left") == 0).select("id")
    deps = pairs.select("id", F.explode("left").alias("b")).select(F.col("id").alias("k"), F.regexp_replace("b", ":[TF]$", "").alias("id"), F.col("b").endswith(":T").alias("when"))
    covered = every_branch(deps, ["k"]).where("covered").select(F.col("k").alias("id"))
    open_ = opened.join(held.select("id").distinct(), "id", "left_semi").join(sure.union(covered).distinct(), "id", "left_anti")
    some = pairs.select("id").distinct().withColumn("some", F.lit(True))
    return open_.join(some, "id", "left").select("file_id", "id", F.when(F.col("some"), "uncertain").otherwise("certain").alias("certainty"))


def _paths(p: Program, listing: DataFrame) -> DataFrame:
    """file_id, id, certainty: paths that are read, are not in the listing, and are not surely written before; uncertain
    where they are written before on some ways."""
    reads = dependencies(p, ["read", "source"]).where("value is not null and not value rlike '^[A-Za-z]+://'").where("name not in ('library')")
    gone = reads.join(listing.select(F.col("path").alias("value")).distinct(), "value", "left_anti")
    writes = dependencies(p, ["write"]).where("value is not null").select("file_id", "id", "value")
    # the path of a write is any argument of it
    args = p.typed(G.ARGUMENT, "id", "arg").join(p.constants.select(F.col("id").alias("arg"), "values"), "arg").select("id", F.explode("values").alias("value"))
    written = p.calls().where(F.col("name").isin(*DEPENDENCIES["write"])).select("file_id", "id").join(args, "id").union(writes.select("id", "file_id", "value")).distinct()
    pairs = gone.select("file_id", F.col("id").alias("b"), "value").join(written.select("file_id", F.col("id").alias("a"), "value"), ["file_id", "value"]).where("a <> b")
    known = p.before(pairs.select("file_id", "a", "b")).groupBy("b").agg(F.bool_or("before").alias("sure"), F.bool_or(F.col("before").isNull()).alias("maybe")).withColumnRenamed("b", "id")
    out = gone.join(known, "id", "left").where("not coalesce(sure, false)")
    return out.select("file_id", "id", F.when(F.coalesce("maybe", F.lit(False)), "uncertain").otherwise("certain").alias("certainty"))


def _frame_accesses(p: Program) -> DataFrame:
    from skein.frontend.shapes import invalid

    return invalid(p.files).select("file_id", "id", F.lit("certain").alias("certainty")).distinct()


def _deprecated(calls: DataFrame, p: Program, table: DataFrame) -> DataFrame:
    """Calls of deprecated functions: table (name, since) or (name, since, argument): with an argument, calls that give it."""
    from skein.operators.lint import deprecated

    if "argument" not in table.columns:
        return deprecated(calls, table)
    whole = deprecated(calls, table.where("argument is null").drop("argument"))
    given = p.nodes.where("role = 'call-argument' and lexeme <> ''").select(F.col("parent_id").alias("id"), F.col("lexeme").alias("argument"))
    some = calls.join(given, "id").join(table.where("argument is not null"), ["name", "argument"])
    return whole.select("file_id", "id").union(some.select("file_id", "id")).distinct()


@query("linter")
def linter(
    p: Program, rules: Sequence[str | tuple[str, Mapping[str, Any]]] | None = None, listing: DataFrame | None = None, deprecated: DataFrame | None = None, exports: DataFrame | None = None
) -> DataFrame:
    """rule, file_id, id, certainty of the rules on programs: names, or names with options. Rules on project files (path,
    role) need a listing, that on deprecated functions a table (name, since[, argument]), that on unused imports the
    packages' exports (package, name).

    Options: `names` (network-functions, problematic-inputs, seeded-randomness), `casing` (naming-convention).
    """
    from skein.operators import lint as L

    strings = p.nodes.where("type = 'RString'").select("file_id", F.col("node_id").alias("id"), constant_of(F.col("value")).alias("text"))
    calls = p.calls()
    net = ("download.file", "url", "GET", "POST", "curl", "install.packages", "source_url", "read_html", "getURL", "socketConnection")
    defined = p.vertices.where("tag = 'variable-definition'").select("file_id", "id", "name")
    secret = p.typed(G.DEFINED_BY, "id", "dst").join(strings.select(F.col("id").alias("dst")), "dst").select("id")
    loops = p.nodes.where("type in ('RForLoop', 'RWhileLoop', 'RRepeatLoop')").select("file_id", F.col("node_id").alias("id"))
    over = p.nodes.where("role = 'for-vector'").select(F.col("parent_id").alias("id"), F.col("node_id").alias("v")).join(p.constants.select(F.col("id").alias("v"), "values"), "v")
    size = F.size(F.split(F.col("values")[0], ", "))
    loops = loops.join(over.select("id", F.when(F.size("values") == 1, size).alias("elements")), "id", "left").join(p.once.select("id", F.lit(True).alias("leaves_always")), "id", "left")
    certain, uncertain = F.lit("certain"), F.lit("uncertain")
    paths = strings.where((F.length("text") >= 3) & F.col("text").rlike(r"^(/|~/|[A-Za-z]:[\\/])"))

    def absolute(**_: Any) -> DataFrame:
        read = p.typed(G.ARGUMENT, "call", "id").join(calls.where(F.col("name").isin(*DEPENDENCIES["read"], *DEPENDENCIES["source"])).select(F.col("id").alias("call")), "call", "left_semi").select("id").distinct()
        return paths.join(read.withColumn("sure", F.lit(True)), "id", "left").withColumn("certainty", F.when(F.col("sure"), certain).otherwise(uncertain))

    found: dict[str, Callable[..., DataFrame]] = {
        "unused-definitions": lambda **_: p.unused_definitions().withColumn("certainty", uncertain),
        "undefined-symbol": lambda **_: p.undefined_symbols().withColumn("certainty", uncertain),
        "dead-code": lambda **_: p.dead_code().withColumn("certainty", certain),
        "syntactically-valid": lambda **_: p.syntax_errors().withColumn("certainty", certain),
        "seeded-randomness": lambda names=None, **_: p.unseeded(tuple(names)) if names else p.unseeded(),
        "network-functions": lambda names=net, **_: calls.where(F.col("name").isin(*names)).withColumn("certainty", certain),
        "stop-call": lambda **_: _stop_calls(p).withColumn("certainty", certain),
        "absolute-file-paths": absolute,
        "naming-convention": lambda casing=None, **_: L.naming(defined.dropDuplicates(["file_id", "name"]), "name", ["file_id"], casing).withColumn("certainty", uncertain),
        "no-leaked-credentials": lambda **_: L.secrets(strings, "text").select("file_id", "id").union(defined.where(F.col("name").rlike(L.SECRET_NAMES)).join(secret, "id", "left_semi").select("file_id", "id")).withColumn("certainty", uncertain),
        "useless-loop": lambda **_: L.useless_loops(loops).withColumn("certainty", certain),
        "problematic-inputs": lambda names=None, **_: (_problematic(p, names) if names else _problematic(p)).withColumn("certainty", uncertain),
        "roxygen-arguments": lambda **_: _documented(p).select("file_id", F.col("function").alias("id"), certain.alias("certainty")).distinct(),
        "unclosed-connection": lambda **_: _unclosed(p),
        "dataframe-access-validation": lambda **_: _frame_accesses(p),
    }
    if listing is not None:
        project = lambda x, rule: L.absent(x, rule).select(F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("string").alias("id"), "certainty")
        found |= {
            "file-path-validity": lambda **_: _paths(p, listing),
            "software-has-license": lambda **_: project(listing.where("role = 'license'"), "software-has-license"),
            "software-has-tests": lambda **_: project(listing.where("role = 'test'"), "software-has-tests"),
        }
    if deprecated is not None:
        found["deprecated-functions"] = lambda **_: _deprecated(calls, p, deprecated).withColumn("certainty", certain)
    if exports is not None:
        found["unused-import"] = lambda **_: p.unused_imports(exports).select("file_id", F.col("call_id").alias("id"), certain.alias("certainty"))
    out = None
    for rule in rules or found:
        name, options = (rule, {}) if isinstance(rule, str) else rule
        one = found[name](**options).select(F.lit(name).alias("rule"), "file_id", "id", "certainty")
        out = one if out is None else out.union(one)
    return out


def quick_fixes(p: Program, findings: DataFrame) -> DataFrame:
    """file_id, start, end, text: edits, over code points, that mend findings (rule, file_id, id): stop() gets
    `call. = FALSE`, a random draw a seed before its statement, an open connection a close after its last use."""
    starts = p.files.select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("file_id").orderBy("at")) - F.length("text") - 1
    lines = starts.select("file_id", (F.col("at") + 1).alias("line"), before.cast("int").alias("offset"), F.length("text").alias("width"))
    at = p.nodes.select("file_id", F.col("node_id").alias("id"), "sl", "sc", "el", "ec", "statement")
    of = lambda rule: findings.where(F.col("rule") == rule).select("file_id", "id").distinct()
    end = of("stop-call").join(at, ["file_id", "id"]).join(lines.withColumnRenamed("line", "el"), ["file_id", "el"])
    given = p.nodes.where("role = 'call-argument'").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    # what `call.` is given is replaced; without it one more argument says so
    value = p.nodes.where("role = 'arg-value'").select(F.col("parent_id").alias("arg"), F.col("sl").alias("line"), F.col("sc").alias("a"), F.col("ec").alias("b"))
    flags = p.nodes.where("role = 'call-argument' and lexeme = 'call.'").select(F.col("parent_id").alias("id"), F.col("node_id").alias("arg")).join(value, "arg")
    told = of("stop-call").join(flags, "id").join(lines, ["file_id", "line"])
    changed = told.select("file_id", (F.col("offset") + F.col("a") - 1).alias("start"), (F.col("offset") + F.col("b")).alias("end"), F.lit("FALSE").alias("text"))
    place = F.col("offset") + F.col("ec") - 1
    stops = end.join(told.select("id"), "id", "left_anti").join(given, "id", "left").select("file_id", place.alias("start"), place.alias("end"), F.when(F.col("n") > 0, ", call. = FALSE").otherwise("call. = FALSE").alias("text"))
    stops = stops.union(changed)
    held = of("seeded-randomness").join(at.select("file_id", "id", F.col("statement").alias("s")), ["file_id", "id"]).select("file_id", F.col("s").alias("id")).distinct()
    begin = held.join(at, ["file_id", "id"]).join(lines.withColumnRenamed("line", "sl"), ["file_id", "sl"])
    first = F.col("offset") + F.col("sc") - 1
    seeds = begin.groupBy("file_id").agg(F.min(first).alias("start")).select("file_id", "start", F.col("start").alias("end"), F.lit("set.seed(1)\n").alias("text"))
    bound = p.typed(G.DEFINED_BY, "d", "id").join(of("unclosed-connection"), ["file_id", "id"]).join(p.vertices.where("tag = 'variable-definition'").select(F.col("id").alias("d"), "name"), "d")
    uses = p.typed(G.READS, "use", "d").select("use", "d").join(at.select(F.col("id").alias("use"), "el"), "use").groupBy("d").agg(F.max("el").alias("last"))
    whole = bound.join(at.select("file_id", "id", "el"), ["file_id", "id"]).join(uses, "d", "left").select("file_id", "name", F.coalesce("last", "el").alias("line"))
    after = whole.join(lines, ["file_id", "line"]).select("file_id", (F.col("offset") + F.col("width")).alias("start"), (F.col("offset") + F.col("width")).alias("end"), F.concat(F.lit("\nclose("), "name", F.lit(")")).alias("text"))
    return stops.union(seeds).union(after)


def fixed(p: Program, findings: DataFrame) -> DataFrame:
    """file_id, content: the files with quick fixes applied."""
    from skein.sources.writers import applied

    edits = quick_fixes(p, findings).groupBy("file_id").agg(F.collect_list(F.struct("start", "end", "text")).alias("edits"))
    return p.files.join(edits, "file_id").select("file_id", applied(F.col("content"), F.col("edits")).alias("content"))


@query("inspect-strictness")
def inspect_strictness(p: Program) -> DataFrame:
    """function, param, strict: TRUE if the parameter's value is used on every way through the function, NULL if on some,
    FALSE if on none."""
    from skein.operators.lint import every_branch

    up = p.nodes.select(F.col("node_id").alias("id"), "parent_id", "role", "lexeme")
    params = up.where("role = 'param-name'").select(F.col("id").alias("param"), F.col("lexeme").alias("name"), F.col("parent_id").alias("p"))
    params = params.join(up.select(F.col("id").alias("p"), F.col("parent_id").alias("function")), "p").select("function", "param", "name")
    reads = p.edges.where(G.includes(F.col("types"), G.READS)).select(F.col("src").alias("use"), F.col("dst").alias("param"))
    uses = params.join(reads, "param").join(p.vertices.select(F.col("id").alias("use"), "branches"), "use")
    free = uses.where(F.size("branches") == 0).select("param").distinct().withColumn("always", F.lit(True))
    # a use under several conditions needs them all; only single ones can make up all branches
    alone = uses.where(F.size("branches") == 1).select("param", F.col("branches")[0].alias("b"))
    deps = alone.select("param", F.regexp_replace("b", ":[TF]$", "").alias("id"), F.col("b").endswith(":T").alias("when"))
    covered = every_branch(deps, ["param"])
    some = uses.select("param").distinct().withColumn("some", F.lit(True))
    out = params.join(free, "param", "left").join(covered, "param", "left").join(some, "param", "left")
    strict = F.when(F.coalesce("always", F.lit(False)) | F.coalesce("covered", F.lit(False)), F.lit(True)).when(F.col("some").isNull(), F.lit(False))
    return out.select("function", F.col("name").alias("param"), strict.alias("strict"))


@query("files")
def files(p: Program, listing: DataFrame, roles: Sequence[str] | None = None, path: str | None = None) -> DataFrame:
    """Project files (path, role) by role and path."""
    out = listing if roles is None else listing.where(F.col("role").isin(list(roles)))
    return out if path is None else out.where(F.col("path").rlike(path))


@query("project")
def project(p: Program, listing: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """key, value: the project's name and version, its files by role, its scripts, nodes, vertices and edges."""
    text = lambda k, c: (F.lit(k).alias("key"), c.cast("string").alias("value"))
    out = listing.groupBy("role").count().select(F.concat(F.lit("files:"), "role").alias("key"), F.col("count").cast("string").alias("value"))
    for name, rows in (("nodes", p.nodes), ("vertices", p.vertices), ("edges", p.edges)):
        out = out.union(rows.agg(F.count("*").alias("n")).select(*text(name, F.col("n"))))
    if fields is not None:
        known = {"Package": "name", "Version": "version", "Title": "title", "License": "license"}
        out = out.union(fields.where(F.col("key").isin(*known)).select(F.lower(F.when(F.col("key") == "Package", "name").otherwise(F.col("key"))).alias("key"), "value"))
    return out


@query("signature")
def signature(p: Program, db: Any, package: str | None = None, function: str | None = None, version: str | None = None, callees: bool = False) -> DataFrame:
    """Packages, functions or callees of a signature database."""
    if callees:
        return db.callees(package, function, version)
    return db.functions(package, function, version) if function else db.packages(package)


@query("guess-dep-versions")
def guess_dep_versions(p: Program, db: Any, constraints: DataFrame | None = None, date: str | None = None, rounds: int = 8) -> DataFrame:
    """pkg, lowest, highest, versions: which versions of the packages that programs attach go with what they call."""
    wanted = p.libraries.select(F.col("package").alias("pkg")).distinct()
    given = constraints if constraints is not None else p.rows.sparkSession.createDataFrame([], "pkg string, constraint string")
    wanted = wanted.join(given, "pkg", "full")
    calls = p.calls().where("size(origin) = 0 or ns is not null").select("name", "ns").distinct()
    qualified = calls.where("ns is not null").select(F.col("ns").alias("pkg"), "name")
    # an unqualified call counts for the only attached package that ever had the function
    owners = calls.where("ns is null").join(db.fn.select("pkg", "name").distinct(), "name").join(wanted.select("pkg"), "pkg", "left_semi")
    sole = owners.groupBy("name").agg(F.min("pkg").alias("pkg"), F.count("*").alias("n")).where("n = 1").select("pkg", "name")
    return db.ranges(db.feasible(wanted, qualified.union(sole), date, rounds))


@query("absint")
def absint(p: Program, sources: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Shapes of the frames of programs: sources (file_id, content)."""
    from skein.frontend.shapes import inferred

    out = inferred(sources)
    return out if names is None else out.where(F.col("name").isin(list(names)))


@query("config")
def config(p: Program, update: Mapping[str, str] | None = None) -> DataFrame:
    """key, value of the session's settings, after the given ones are set."""
    spark = p.rows.sparkSession
    for k, v in (update or {}).items():
        spark.conf.set(k, v)
    return spark.createDataFrame(sorted((k, str(v)) for k, v in spark.conf.getAll.items()), "key string, value string")


@query("all-criteria")
def all_criteria(p: Program, least: int = 1, most: int = 1) -> DataFrame:
    """file_id, criteria: every choice of `least` to `most` variables of a file, as criteria `line@[n]name`. Choices of several
    are all combinations within a file, so `most` should be small."""
    named = p.nodes.join(p.vertices.where("tag in ('use', 'variable-definition')").select(F.col("id").alias("node_id")), "node_id", "left_semi").where("type = 'RSymbol'")
    nth = F.row_number().over(Window.partitionBy("file_id", "sl", "lexeme").orderBy("sc"))
    one = named.withColumn("n", nth).select("file_id", F.struct("sl", "sc", F.concat("sl", F.lit("@["), "n", F.lit("]"), "lexeme").alias("c")).alias("x"))
    chosen = one.select("file_id", F.array("x").alias("xs"))
    out = chosen if least <= 1 else None
    for size in range(2, most + 1):
        chosen = chosen.join(one, "file_id").where(F.element_at("xs", -1) < F.col("x")).select("file_id", F.concat("xs", F.array("x")).alias("xs"))
        if size >= least:
            out = chosen if out is None else out.union(chosen)
    return out.select("file_id", F.transform("xs", lambda x: x["c"]).alias("criteria"))


@query("qualify")
def qualify(p: Program, exports: DataFrame | None = None) -> DataFrame:
    """id, file_id, qualified: calls as `package::name`: by the package in front, or that of the only attached package whose
    exports (package, name) have the name; own functions stay as they are."""
    calls = p.calls().select("id", "file_id", "name", "ns")
    if exports is not None:
        mine = p.typed(G.CALLS, "id", "f").select("id").distinct()
        attached = p.libraries.select("file_id", "package").distinct().join(exports, "package")
        owner = calls.where("ns is null").join(mine, "id", "left_anti").join(attached, ["file_id", "name"]).groupBy("id").agg(F.min("package").alias("owner"), F.count("*").alias("n")).where("n = 1")
        calls = calls.join(owner.select("id", "owner"), "id", "left").withColumn("ns", F.coalesce("ns", "owner"))
    return calls.select("id", "file_id", F.when(F.col("ns").isNotNull(), F.concat("ns", F.lit("::"), "name")).otherwise(F.col("name")).alias("qualified"))


@query("working-directory")
def working_directory(p: Program) -> DataFrame:
    """id, file_id, directory: where each call outside functions runs, after the setwd() calls of constants above it; empty
    where none is, NULL where one of them is no constant."""
    calls = p.calls().where("owner is null").select("id", "file_id", "name", "sl", "sc")
    given = p.typed(G.ARGUMENT, "id", "arg").join(p.constants.select(F.col("id").alias("arg"), "values"), "arg").where("size(values) = 1").select("id", F.col("values")[0].alias("to"))
    moves = calls.join(given, "id", "left").withColumn("move", F.when(F.col("name") == "setwd", F.struct("to", F.lit(True).alias("is"))))
    before = F.collect_list("move").over(Window.partitionBy("file_id").orderBy("sl", "sc").rowsBetween(Window.unboundedPreceding, -1))
    absolute = lambda t: t.rlike(r"^(/|~|[A-Za-z]:)")
    step = lambda at, m: F.when(m["to"].isNull(), F.lit(None).cast("string")).when(absolute(m["to"]), m["to"]).otherwise(F.concat(at, F.when(at != "", F.lit("/")).otherwise(""), m["to"]))
    return moves.select("id", "file_id", F.aggregate(before, F.lit(""), step).alias("directory"))


@query("invariants")
def invariants(p: Program) -> DataFrame:
    """file_id, id, problem: what no flow may have: edges to nothing, statements of the file that no edge touches although
    there are several."""
    ids = p.nodes.select(F.col("node_id").alias("id"))
    ends = p.flow_edges().select("file_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    loose = ends.join(ids, "id", "left_anti").select("file_id", "id", F.lit("edge to nothing").alias("problem"))
    top = p.nodes.where("depth = 1 and role = 'expr-list-child' and type <> 'RError'").select("file_id", F.col("node_id").alias("id"))
    several = top.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1")
    alone = top.join(several.select("file_id"), "file_id", "left_semi").join(ends.select("id"), "id", "left_anti").join(p.dead_code().select("id"), "id", "left_anti")
    return loose.union(alone.select("file_id", "id", F.lit("statement without edges")))


@query("search")
def search(p: Program, build: Callable[[S.Search], S.Search]) -> DataFrame:
    """A search over the program's nodes."""
    return build(S.Search(p.nodes)).frame
