"""What can be added from outside: readers of files by key, steps of a pipeline, output formats.

A plugin is a function under a key; register() adds one or puts another in its place. Steps say which others they need
and are run in that order; a decorator is a step that takes another's result and gives it back changed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources import bson, files, rdata
from skein.sources import writers as W

Plugin = Callable[..., Any]


def _versions(read: Callable[[DataFrame], DataFrame]) -> Plugin:
    """A reader of files as package, version and where that is said."""

    def run(given: DataFrame) -> DataFrame:
        got = read(given)
        version = "constraint" if "constraint" in got.columns else "version"
        return got.select("path", "package", F.col(version).alias("version"))

    return run


#: Readers of project files by key.
PLUGINS: dict[str, Plugin] = {
    "file:description": files.dcf, "file:namespace": files.namespace, "file:news": files.news, "file:rmd": files.rmarkdown, "file:qmd": files.rmarkdown, "file:rnw": files.sweave,
    "file:ipynb": files.jupyter, "file:rda": rdata.objects, "file:rproject": files.toml, "file:uvr": files.toml, "file:license": lambda f: files.licenses(files.dcf(f)),
    "versions:description": _versions(lambda f: files.dependencies(files.dcf(f))), "versions:renv": _versions(files.renv), "versions:packrat": _versions(files.packrat),
    "versions:rv": _versions(lambda f: files.toml_packages(files.toml(f))), "versions:uvr": _versions(lambda f: files.toml_packages(files.toml(f))),
    "versions:session-info": _versions(files.session_info), "versions:library": _versions(files.library), "versions:namespace": lambda f: files.namespace_imports(files.namespace(f)),
    "meta:description": files.meta, "meta:rproject": lambda f: files.manifest_meta(files.toml(f)), "meta:uvr": lambda f: files.manifest_meta(files.toml(f)),
}


def register(key: str, plugin: Plugin) -> None:
    PLUGINS[key] = plugin


def versions(given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """origin, path, package, version of all that the readers say about packages: one union of dimension rows."""
    out = None
    for key in keys:
        one = PLUGINS[key](given).select(F.lit(key).alias("origin"), "path", "package", "version")
        out = one if out is None else out.unionByName(one)
    return out


class Steps:
    """Named steps: each a function of the results of the steps that it needs."""

    def __init__(self) -> None:
        self.steps: dict[str, tuple[Plugin, tuple[str, ...]]] = {}
        self.around: dict[str, list[Plugin]] = {}

    def add(self, name: str, run: Plugin, needs: Sequence[str] = ()) -> Steps:
        if name in self.steps:
            raise ValueError(f"two steps are called {name}")
        self.steps[name] = (run, tuple(needs))
        return self

    def decorate(self, name: str, change: Plugin) -> Steps:
        """`change` gets the step's result and gives the one that others see."""
        self.around.setdefault(name, []).append(change)
        return self

    def order(self) -> list[str]:
        """The steps, each after those that it needs; raises where some need one another in a ring or are not there."""
        done: list[str] = []
        left = dict(self.steps)
        while left:
            ready = [n for n, (_, needs) in left.items() if all(x in done for x in needs)]
            if not ready:
                raise ValueError(f"steps wait for one another or for unknown ones: {sorted(left)}")
            done += ready
            for n in ready:
                del left[n]
        return done

    def run(self, until: str | None = None, **given: Any) -> dict[str, Any]:
        """The results by name, of all steps or of those that `until` needs."""
        wanted = set(self.steps)
        if until is not None:
            wanted, todo = set(), [until]
            while todo:
                n = todo.pop()
                if n not in wanted:
                    wanted.add(n)
                    todo += self.steps[n][1]
        out = dict(given)
        for n in self.order():
            if n in wanted and n not in out:
                run, needs = self.steps[n]
                out[n] = run(*(out[x] for x in needs))
                for change in self.around.get(n, ()):
                    out[n] = change(out[n])
        return out


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


#: Output formats of the steps' results: (what, format) -> lines.
FORMATS: dict[tuple[str, str], Plugin] = {
    ("dataflow", "json"): lambda p: _lines(p.data_edges()), ("dataflow", "quads"): lambda p: W.edge_quads(p.data_edges(), "dataflow").withColumnRenamed("quad", "line"),
    ("dataflow", "mermaid"): lambda p: W.mermaid(p.data_edges()), ("dataflow", "text"): lambda p: W.outline(p.data_edges()).select("line"),
    ("dataflow", "compact"): lambda p: bson.encoded(p.data_edges().select("file_id", "src", "dst", "types")),
    ("ast", "json"): lambda p: _lines(p.nodes), ("ast", "quads"): lambda p: W.row_quads(p.nodes.select("node_id", "type", "lexeme", "role", "parent_id"), "node_id", "ast").withColumnRenamed("quad", "line"),
    ("ast", "text"): lambda p: W.tree(p.nodes).select(F.col("text").alias("line")),
    ("ast", "mermaid"): lambda p: W.mermaid(p.nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit(64).alias("types"))),
    ("cfg", "json"): lambda p: _lines(p.flow_edges()), ("cfg", "quads"): lambda p: W.edge_quads(p.flow_edges(), "cfg").withColumnRenamed("quad", "line"), ("cfg", "mermaid"): lambda p: W.mermaid(p.flow_edges()),
    ("files", "quads"): lambda p: W.row_quads(p.files, "file_id", "files").withColumnRenamed("quad", "line"),
}


def rendered(program: Any, what: str, form: str) -> DataFrame:
    """A program's tree, data flow or control flow in an output format."""
    if (what, form) not in FORMATS:
        raise ValueError(f"no {form} of {what}")
    return FORMATS[what, form](program)
