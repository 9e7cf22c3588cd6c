"""Programs as tables: one Python step parses each file, everything after it is DataFrame work."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.frontend import local
from skein.operators import graph as G
from skein.storage import discard, stored

_KINDS = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_ROW = (
    "file_id string, kind string, id string, parent_id string, type string, lexeme string, role string, idx int, nest int, depth int, "
    "sl int, sc int, el int, ec int, statement string, owner string, name string, ns string, origin array<string>, cds array<string>, dst string, types int, value string"
)
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in _ROW.split(", "))])
_LOOPS = ("RForLoop", "RWhileLoop", "RRepeatLoop", "RIfThenElse")


def _rows(file_id: str, text: str, sources: Mapping[str, str] | None = None, kinds: Mapping[str, str] | None = None) -> Iterator[dict]:
    from skein.frontend.dataflow import DEEPEST, analyse
    from skein.frontend.values import Values

    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    flow = analyse(text, sources, kinds)
    key = lambda i: f"{file_id}:{i}"
    statements = {i for pair, bits in flow.edges.items() if bits & (G.FLOW | G.CONTROL) for i in pair} | {c.id for _, c in flow.root.children}
    todo = [(flow.root, None, "root", 0, 0, 0, None, None)]
    while todo:
        n, parent, role, idx, nest, depth, statement, owner = todo.pop()
        statement = key(n.id) if n.id in statements else statement
        yield {
            "file_id": file_id, "kind": "node", "id": key(n.id), "parent_id": parent, "type": n.type, "lexeme": n.lexeme, "role": role, "idx": idx, "nest": nest, "depth": depth,
            "sl": n.start[0], "sc": n.start[1], "el": n.end[0], "ec": n.end[1], "statement": statement, "owner": owner, "value": json.dumps(n.value, default=str) if n.value is not None else None,
        }
        more, inside = nest + (n.type in _LOOPS), key(n.id) if n.type == "RFunctionDefinition" else owner
        todo += [(c, key(n.id), r, i, more, depth + 1, statement, inside) for i, (r, c) in enumerate(n.children)]
    for i, (tag, name, ns, origin, cds) in flow.vertices.items():
        yield {"file_id": file_id, "kind": "vertex", "id": key(i), "type": tag, "name": name, "ns": ns, "origin": origin, "cds": [key(c) for c in cds]}
    for (src, dst), bits in flow.edges.items():
        yield {"file_id": file_id, "kind": "edge", "id": key(src), "dst": key(dst), "types": bits}
    for i, package in flow.libraries:
        yield {"file_id": file_id, "kind": "library", "id": key(i), "name": package}
    for i, path in flow.sourced:
        yield {"file_id": file_id, "kind": "source", "id": key(i), "name": path}
    for i in flow.unknown:
        yield {"file_id": file_id, "kind": "unknown", "id": key(i)}
    for i in flow.unreached():
        yield {"file_id": file_id, "kind": "unreached", "id": key(i)}
    for i in flow.once:
        yield {"file_id": file_id, "kind": "once", "id": key(i)}
    values = Values(flow)
    for i, (tag, *_) in flow.vertices.items():
        if tag != "function-definition" and (found := values.of(i)):
            yield {"file_id": file_id, "kind": "constant", "id": key(i), "value": json.dumps(sorted(map(_shown, found)))}


def _shown(value) -> str:
    """A constant as text: numbers as they are written shortest, vectors in c()."""
    if isinstance(value, tuple):
        return f"c({', '.join(map(_shown, value))})"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return value if isinstance(value, str) else f"{value:.15g}"


def _failed(file_id: str, text: str, problem: Exception) -> list[dict]:
    """A file that cannot be analysed is one error node over all its lines, and stops no other file."""
    root = {"file_id": file_id, "kind": "node", "id": f"{file_id}:0", "type": "RExpressionList", "lexeme": "", "role": "root", "idx": 0, "nest": 0, "depth": 0, "sl": 1, "sc": 1, "el": 1, "ec": 1}
    bad = {"id": f"{file_id}:1", "parent_id": f"{file_id}:0", "type": "RError", "lexeme": f"{type(problem).__name__}: {problem}"[:200], "role": "expr-list-child", "depth": 1, "el": text.count("\n") + 1}
    return [root, root | bad]


def _analysed(kinds: Mapping[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for file_id, text, *more in zip(*columns, strict=True):
                sources = dict(more[0]) if more and more[0] else None
                try:
                    rows = list(_rows(file_id, text or "", sources, kinds))
                except (RecursionError, ValueError, IndexError, AttributeError, KeyError) as x:
                    rows = _failed(file_id, text or "", x)
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


class Program:
    """nodes, vertices, edges and libraries of files (file_id, content). Ids are `file:number`.

    Files that source others of the table by a constant path are analysed with these in place; a path is known by the
    file's whole id or the end of it. `kinds`: what calls of a name do, beside or instead of the built-in table.
    """

    def __init__(self, files: DataFrame, kinds: Mapping[str, str] | None = None):
        from skein.frontend.shipping import ship

        ship(files.sparkSession)
        self.files, self.kinds = files.select(F.col("file_id").cast("string").alias("file_id"), "content"), kinds
        self.rows = stored(self.files.mapInArrow(_analysed(kinds), _ROW), "program")
        self._link_sources(kinds)
        self._tables()

    def _tables(self) -> None:
        of = lambda kind, *columns: self.rows.where(F.col("kind") == kind).select(*columns)
        self.nodes = of(
            "node", "file_id", F.col("id").alias("node_id"), "parent_id", "type", "lexeme", "role", "idx", "nest", "depth", "sl", "sc", "el", "ec", "value", "statement", "owner"
        )
        self.vertices = of("vertex", "file_id", "id", F.col("type").alias("tag"), "name", "ns", "origin", F.transform("cds", lambda c: F.regexp_replace(c, ":[TF]$", "")).alias("cds"), F.col("cds").alias("branches"))
        self.edges = of("edge", "file_id", F.col("id").alias("src"), "dst", "types")
        self.libraries = of("library", "file_id", F.col("id").alias("call_id"), F.col("name").alias("package"))
        self.sources = of("source", "file_id", F.col("id").alias("call_id"), F.col("name").alias("path"))
        self.unknown_effects = of("unknown", "file_id", "id")
        self.once = of("once", "file_id", "id")
        #: What vertices stand for where that can be told: values array<string>, one for each possible value.
        self.constants = of("constant", "file_id", "id", F.from_json("value", "array<string>").alias("values"))

    def _link_sources(self, kinds: Mapping[str, str] | None) -> None:
        """Analyses files that source known ones again, with the texts of these and of what they source in turn."""
        asked = self.rows.where("kind = 'source'").select("file_id", F.col("name").alias("path")).distinct()
        if asked.isEmpty():
            return
        last = lambda c: F.substring_index(F.col(c), "/", -1)
        known = self.files.select(F.col("file_id").alias("target"))
        links = asked.join(known, (last("path") == last("target")) & ((F.col("path") == F.col("target")) | F.col("target").endswith(F.concat(F.lit("/"), F.regexp_replace("path", r"^\./", "")))))
        links = stored(links.groupBy("file_id", "path").agg(F.min("target").alias("target")), "links")
        roots = links.select(F.col("file_id").alias("root"), F.col("file_id").alias("id")).distinct()
        reached = G.closure(links.select(F.col("file_id").alias("src"), F.col("target").alias("dst")), roots).select("root", F.col("id").alias("file_id"))
        wanted = reached.join(links, "file_id").select("root", "path", "target").groupBy("root", "path").agg(F.min("target").alias("target"))
        texts = wanted.join(self.files.select(F.col("file_id").alias("target"), F.coalesce("content", F.lit("")).alias("text")), "target")
        bundles = texts.groupBy(F.col("root").alias("file_id")).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("sources"))
        again = self.files.join(bundles, "file_id").select("file_id", "content", "sources").mapInArrow(_analysed(kinds), _ROW)
        before = self.rows
        self.rows = stored(before.join(roots.select(F.col("root").alias("file_id")), "file_id", "left_anti").select(*before.columns).unionByName(again), "program")
        discard(before)

    def updated(self, files: DataFrame, removed: DataFrame | None = None) -> Program:
        """The program after some files (file_id, content) have changed or come, and others (file_id) have gone: only files
        whose text is another one, and those that source them, are analysed again."""
        from skein.functions.text import content_hash

        given = files.select(F.col("file_id").cast("string").alias("file_id"), "content")
        old = self.files.select("file_id", content_hash(F.col("content")).alias("was"))
        fresh = given.join(old, "file_id", "left").where(F.col("was").isNull() | (F.col("was") != content_hash(F.col("content")))).select("file_id", "content")
        fresh = stored(fresh, "fresh")
        gone = fresh.select("file_id") if removed is None else fresh.select("file_id").union(removed.select(F.col("file_id").cast("string"))).distinct()
        out = object.__new__(Program)
        out.files = stored(self.files.join(gone, "file_id", "left_anti").unionByName(fresh), "files")
        # a file that sources a changed one is read anew as well
        users = self.sources.select("file_id").distinct() if not gone.isEmpty() else gone.limit(0)
        again = out.files.join(fresh.select("file_id").union(users).distinct(), "file_id", "left_semi")
        kept = self.rows.join(gone.union(users).distinct(), "file_id", "left_anti")
        out.kinds = self.kinds
        out.rows = stored(kept.unionByName(again.mapInArrow(_analysed(self.kinds), _ROW)), "program")
        out._link_sources(self.kinds)
        out._tables()
        return out

    def data_edges(self) -> DataFrame:
        return G.without_types(self.edges, G.FLOW | G.CONTROL)

    def flow_edges(self) -> DataFrame:
        return self.edges.where(G.includes(F.col("types"), G.FLOW))

    def typed(self, mask: int, *names: str) -> DataFrame:
        """file_id and the two ends, under the names given, of the edges that have a bit of mask."""
        src, dst = names or ("src", "dst")
        return self.edges.where(G.includes(F.col("types"), mask)).select("file_id", F.col("src").alias(src), F.col("dst").alias(dst))

    def criterion(self, *criteria: str) -> DataFrame:
        """Vertices (file_id, id) that criteria name: see skein.operators.search."""
        from skein.operators.search import Search

        at = Search(self.nodes.join(self.vertices.select(F.col("id").alias("node_id")), "node_id", "left_semi"), all_nodes=self.nodes)
        return at.criterion(*criteria).frame.select("file_id", F.col("node_id").alias("id"))

    def slice(self, *criteria: str, forward: bool = False, callees: bool = False) -> DataFrame:
        """file_id, id in the static slice for the criteria; with callees, of what calls the functions around them too."""
        ids = self.criterion(*criteria)
        if callees:
            owners = self.nodes.select("file_id", F.col("node_id").alias("id"), "owner").join(ids, ["file_id", "id"], "left_semi").where("owner is not null")
            callers = owners.select("file_id", F.col("owner").alias("dst")).join(self.typed(G.CALLS), ["file_id", "dst"]).select("file_id", F.col("src").alias("id"))
            ids = ids.union(callers).distinct()
        return self.slice_ids(ids, forward)

    def slice_ids(self, ids: DataFrame, forward: bool = False) -> DataFrame:
        """file_id, id in the slice for ids (file_id, id): see skein.operators.graph.static_slice for its rules."""
        edges = self.data_edges().where(~G.includes(F.col("types"), G.NSE))
        edges = edges.select("file_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "types") if forward else edges
        plain = G.includes(F.col("types"), G.FOLLOWED | G.SIDE_EFFECT)
        always = edges.where(plain).select("file_id", "src", "dst")
        if not forward:
            always = always.union(self.vertices.select("file_id", F.col("id").alias("src"), F.explode("cds").alias("dst")))
        twice = edges.where(G.includes(F.col("types"), G.DEFINES_ON_CALL | G.DEFINED_BY_ON_CALL) & ~plain).select("file_id", "src", "dst")
        return local.sliced(always, twice, ids)

    def free_names(self, ids: DataFrame) -> DataFrame:
        """file_id, name: names that vertices of a slice (file_id, id) read and none of the slice defines."""
        own = self.vertices.join(ids, ["file_id", "id"], "left_semi")
        defined = own.where("tag = 'variable-definition'").select("file_id", "name")
        used = own.where("tag = 'use' or (tag = 'function-call' and array_contains(origin, 'function'))").select("file_id", "name")
        return used.distinct().join(defined, ["file_id", "name"], "left_anti")

    def extended(self, ids: DataFrame) -> DataFrame:
        """file_id, id: all nodes of the statements that ids lie in."""
        of = self.nodes.join(ids.select("file_id", F.col("id").alias("node_id")), ["file_id", "node_id"], "left_semi").select("file_id", "statement").distinct()
        return self.nodes.join(of, ["file_id", "statement"], "left_semi").select("file_id", F.col("node_id").alias("id"))

    def lines(self, ids: DataFrame) -> DataFrame:
        """file_id, line: the lines on which the ids' nodes start, with the first and last lines of the blocks around them."""
        starts = self.nodes.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        out = starts.select("file_id", F.col("sl").alias("line"))
        blocks = self.nodes.where("type = 'RExpressionList' and lexeme = '{'").select(F.col("file_id").alias("f"), F.col("sl").alias("a"), F.col("el").alias("b"))
        around = starts.select("file_id", "sl").distinct().join(blocks, (F.col("file_id") == F.col("f")) & F.col("sl").between(F.col("a"), F.col("b")))
        return out.union(around.select("file_id", F.explode(F.array("a", "b")).alias("line"))).distinct()

    def code(self, ids: DataFrame, keep: str | None = r"#\s*keep\b") -> DataFrame:
        """file_id, code: the text of a slice. Statements that hold an id stay whole, with the heads and ends of the blocks
        around them; so do lines whose comment matches `keep`, and those between `keep-start` and `keep-end`."""
        whole = self.extended(ids)
        spans = self.nodes.join(whole.select(F.col("id").alias("node_id")), "node_id", "left_semi").where("type <> 'RExpressionList'")
        # a control statement's own lines are its head's; its body comes with what the slice holds of it
        ends = F.when(F.col("type").isin(*_LOOPS, "RFunctionDefinition"), F.col("sl")).otherwise(F.col("el"))
        simple = spans.join(self.nodes.where("type in ('RExpressionList', 'RFunctionDefinition') and lexeme in ('{', 'function', '\\\\')").select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")
        held = simple.select("file_id", F.explode(F.sequence("sl", ends)).alias("line"))
        lines = self.lines(ids).unionByName(held)
        text = self.files.select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file_id", (F.col("at") + 1).alias("line"), "text")
        if keep:
            marked = text.select("file_id", "line", F.col("text").rlike(keep).alias("own"), F.when(F.col("text").rlike(r"#\s*keep-start\b"), 1).when(F.col("text").rlike(r"#\s*keep-end\b"), -1).otherwise(0).alias("turn"))
            open_ = F.sum("turn").over(Window.partitionBy("file_id").orderBy("line"))
            lines = lines.unionByName(marked.withColumn("open", open_).where("own or open > 0 or turn <> 0").select("file_id", "line"))
        chosen = text.join(lines.distinct(), ["file_id", "line"])
        return chosen.groupBy("file_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])).alias("code"))

    def calls(self) -> DataFrame:
        """file_id, id, name, ns, origin and place of each call."""
        at = self.nodes.select(F.col("node_id").alias("id"), "sl", "sc", "el", "ec", "statement", "owner")
        return self.vertices.where("tag = 'function-call' and name is not null").join(at, "id")

    def call_graph(self, unreachable: bool = True) -> DataFrame:
        """Edges (src, dst) between functions, by their definitions; calls outside all functions come from `file:top`.
        Without the unreachable ones, only functions that the top of a file calls, directly or not."""
        functions = self.vertices.where("tag = 'function-definition'").select("file_id", F.col("id").alias("dst"))
        made = self.typed(G.CALLS, "id", "dst").join(functions, ["file_id", "dst"], "left_semi")
        owner = self.nodes.select("file_id", F.col("node_id").alias("id"), "owner")
        src = F.coalesce("owner", F.concat("file_id", F.lit(":top")))
        out = made.join(owner, ["file_id", "id"]).select("file_id", src.alias("src"), "dst").distinct().withColumn("types", F.lit(G.CALLS))
        if unreachable:
            return out
        tops = out.where(F.col("src") == F.concat("file_id", F.lit(":top"))).select("file_id", F.col("src").alias("root"), F.col("src").alias("id")).distinct()
        return out.join(local.closure(out, tops).select("file_id", F.col("id").alias("src")), ["file_id", "src"], "left_semi")

    def unused_definitions(self) -> DataFrame:
        """Definitions that nothing reads. Parameters of methods do not count, as their generic says what they are."""
        read = self.edges.where(G.includes(F.col("types"), G.READS)).select(F.col("dst").alias("id")).distinct()
        return self.vertices.where("tag = 'variable-definition'").join(read, "id", "left_anti").select("file_id", "id", "name")

    def undefined_symbols(self) -> DataFrame:
        """Uses and calls whose name nothing in the file defines, that are no built-ins, and that no loaded file may define."""
        known = self.typed(G.READS, "id", "dst").join(self.vertices.where("tag = 'variable-definition'").select(F.col("id").alias("dst"), F.col("name").alias("n")), "dst")
        loaded = self.typed(G.READS, "id", "dst").join(self.unknown_effects.select(F.col("id").alias("dst")), "dst", "left_semi").select("id")
        quoted = self.edges.where(G.includes(F.col("types"), G.NSE)).select(F.col("dst").alias("id"))
        uses = self.vertices.where("tag = 'use' and ns is null").join(quoted, "id", "left_anti")
        calls = self.vertices.where("tag = 'function-call' and ns is null and name is not null and size(origin) = 0")
        both = uses.unionByName(calls).join(loaded, "id", "left_anti")
        return both.join(known.select("id", F.col("n").alias("name")), ["id", "name"], "left_anti").select("file_id", "id", "name")

    def dead_code(self) -> DataFrame:
        """Statements that no way from the file's or a function's beginning reaches; found file by file as they are parsed."""
        return self.rows.where("kind = 'unreached'").select("file_id", "id")

    def syntax_errors(self) -> DataFrame:
        return self.nodes.where("type = 'RError'").select("file_id", F.col("node_id").alias("id"), "lexeme", "sl")

    def statement_of(self) -> DataFrame:
        """file_id, id, statement: for each node the innermost flow vertex that holds it."""
        return self.nodes.select("file_id", F.col("node_id").alias("id"), "statement")

    def before(self, pairs: DataFrame) -> DataFrame:
        """pairs (file_id, a, b) of nodes with `before`, as in skein.operators.graph.happens_before; and whether b's
        statement is reached at all."""
        at = self.statement_of()
        asked = pairs.join(at.select("file_id", F.col("id").alias("a"), F.col("statement").alias("sa")), ["file_id", "a"]).join(at.select("file_id", F.col("id").alias("b"), F.col("statement").alias("sb")), ["file_id", "b"])
        known = local.happens_before(self.flow_edges(), asked.select("file_id", F.col("sa").alias("a"), F.col("sb").alias("b")))
        return asked.join(known.select("file_id", F.col("a").alias("sa"), F.col("b").alias("sb"), "before"), ["file_id", "sa", "sb"], "left").select("file_id", "a", "b", "before")

    def unseeded(self, random: tuple[str, ...] = ("rnorm", "runif", "sample", "rbinom", "rexp", "rpois", "rgamma", "rbeta", "rt", "rchisq"), seed: str = "set.seed") -> DataFrame:
        """file_id, id, name, certainty: random calls that no seed of a constant surely comes before. Uncertain where such
        a seed stands before on some ways only."""
        calls = self.calls()
        given = self.typed(G.ARGUMENT, "id", "arg").join(self.constants.select(F.col("id").alias("arg")), "arg", "left_semi").select("id")
        seeds = calls.where(F.col("name") == seed).join(given, "id", "left_semi").select("file_id", F.col("id").alias("a"), F.col("sl").alias("line"))
        users = calls.where(F.col("name").isin(*random))
        pairs = users.select("file_id", F.col("id").alias("b"), "owner", "sl").join(seeds, "file_id")
        known = self.before(pairs.where("owner is null").select("file_id", "a", "b")).select("b", "before")
        # a function runs when it is called: a seed above it counts
        known = known.union(pairs.where("owner is not null and line < sl").select("b", F.lit(True).alias("before")))
        best = known.groupBy("b").agg(F.bool_or("before").alias("sure"), F.bool_or(F.col("before").isNull()).alias("maybe")).withColumnRenamed("b", "id")
        open_ = users.join(best, "id", "left").where("not coalesce(sure, false)")
        return open_.select("file_id", "id", "name", F.when(F.coalesce("maybe", F.lit(False)), "uncertain").otherwise("certain").alias("certainty"))

    def unused_imports(self, exports: DataFrame) -> DataFrame:
        """Attached packages of which no exported function (package, name) is called and no name is qualified."""
        called = self.calls().select("file_id", "name", "ns")
        used = called.join(exports, "name").select("file_id", "package").union(called.where("ns is not null").select("file_id", F.col("ns").alias("package")))
        return self.libraries.join(used.distinct(), ["file_id", "package"], "left_anti")


def constant_of(value: Column) -> Column:
    """The text of a node's value, which is kept as JSON."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
