"""The search algebra: one generator, then transformers, over a table of nodes.

Nodes have file_id, node_id, type, lexeme, role, parent_id and a location sl, sc, el, ec (lines and columns from 1). A
search is a plan: nothing runs until its frame is used, and Catalyst sees the whole chain, so filters reach the scan.

    Search(nodes).get(name="x", line=3).filter(kind("RSymbol")).take(5).frame
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import ranges as R


def _order(keys: Sequence[str]) -> list[Column]:
    return [F.col("sl").asc_nulls_last(), F.col("sc").asc_nulls_last(), *[F.col(k) for k in keys]]


# filters


def kind(*types: str) -> Column:
    return F.col("type").isin(*types)


def role(*roles: str) -> Column:
    return F.col("role").isin(*roles)


def in_file(pattern: str) -> Column:
    """The path matches; a missing path counts as empty."""
    return F.coalesce(F.col("path"), F.lit("")).rlike(pattern)


def named_arguments_only() -> Column:
    """Drops arguments without a name."""
    return ~((F.col("type") == "RArgument") & F.col("lexeme").isNull())


def origin(names: Sequence[str], every: bool = False, keep_others: bool = False) -> Column:
    """Calls some or all of whose origins are among the names; other nodes as told."""
    among = F.forall("origin", lambda x: x.isin(*names)) if every else F.exists("origin", lambda x: x.isin(*names))
    return F.when(F.col("origin").isNull(), F.lit(keep_others)).otherwise(among)


def call_props(mask: int, every: bool = False, column: str = "props") -> Column:
    got = F.col(column).bitwiseAND(F.lit(mask))
    return got == mask if every else got != 0


def enrichment(name: str, pattern: str, every: bool = False) -> Column:
    """Nodes whose enrichment, an array of texts, matches somewhere or throughout."""
    return F.forall(name, lambda x: x.rlike(pattern)) if every else F.exists(name, lambda x: x.rlike(pattern))


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def one_of(a: Column, b: Column) -> Column:
    return a != b


class Search:
    """A search and its transformers. `keys` tell all nodes apart and break ties of location."""

    def __init__(self, nodes: DataFrame, keys: Sequence[str] = ("file_id", "node_id"), frame: DataFrame | None = None, all_nodes: DataFrame | None = None):
        self.nodes, self.keys = nodes, list(keys)
        self.frame = nodes.dropDuplicates(self.keys) if frame is None else frame
        #: The whole tree, where `nodes` is a part of it.
        self.all_nodes = nodes if all_nodes is None else all_nodes

    def _with(self, frame: DataFrame) -> Search:
        return Search(self.nodes, self.keys, frame, self.all_nodes)

    # generators

    def all(self, path: str | None = None) -> Search:
        return self._with(self.frame if path is None else self.frame.where(in_file(path)))

    def get(
        self, *, line: int | None = None, column: int | None = None, id: str | None = None, name: str | None = None,
        regex: bool = False, path: str | None = None, fuzzy: bool = False, innermost: bool = False,
    ) -> Search:
        """Nodes that meet all given conditions. A negative line counts from its file's last line; fuzzy: the range
        holds the place; innermost: only nodes that hold no other node found."""
        out = self.frame
        if path is not None:
            out = out.where(in_file(path))
        if id is not None:
            out = out.where(F.col("node_id") == id)
        if name is not None:
            out = out.where(F.col("lexeme").rlike(f"^(?:{name})$") if regex else F.col("lexeme") == name)
        at: Column | None = None
        if line is not None and line < 0:
            last = self.nodes.groupBy("file_id").agg((F.max("el") + 1 + line).alias("_line"))
            out, at = out.join(last, "file_id"), F.col("_line")
        elif line is not None:
            at = F.lit(line)
        r = R.columns()
        if fuzzy and at is not None:
            out = out.where(R.contains(r, at, F.lit(column)) if column is not None else at.between(r.sl, r.el))
        else:
            if at is not None:
                out = out.where(r.sl == at)
            if column is not None:
                out = out.where(r.sc == column)
        out = out.drop("_line")
        if innermost:
            inner = out.select(F.col("file_id").alias("_f"), *[F.col(c).alias(f"_{c}") for c in ("sl", "sc", "el", "ec")])
            out = out.join(inner, (F.col("file_id") == F.col("_f")) & R.is_strict_subset(R.columns("_"), r), "left_anti")
        return self._with(out)

    def var(self, name: str) -> Search:
        return self.get(name=name)

    def var_in_line(self, name: str, line: int) -> Search:
        return self.get(name=name, line=line)

    def loc(self, line: int, column: int) -> Search:
        return self.get(line=line, column=column)

    def loc_fuzzy(self, line: int, column: int) -> Search:
        return self.get(line=line, column=column, fuzzy=True)

    def criterion(self, *criteria: str) -> Search:
        """Slicing criteria: `$id`, `line:column`, `line~column` (a range that holds the place), `line@name` (the first of
        that name in a file's line), `line@[n]name` (the n-th, from the end if n is negative), `line^` (the statement of
        the file on that line). A negative line counts from the file's end. A regular expression in parentheses after the
        criterion says which files it is for."""
        out: Search | None = None
        for text in criteria:
            if text.startswith("$"):
                one = self.get(id=text[1:])
            else:
                c, only = _file_filter(text)
                here = self if only is None else self._with(self.frame.where(F.col("file_id").rlike(only)))
                one = here._placed(c)
            out = one if out is None else out.merge(one)
        if out is None:
            raise ValueError("no criteria")
        return out.unique()

    def _placed(self, c: str) -> Search:
        if m := re.fullmatch(r"(-?\d+)@(?:\[(-?\d+)\])?(.+)", c, re.S):
            line, n, name = int(m[1]), int(m[2] or 1), m[3]
            found = self.get(line=line, name=name).frame
            order = _order(self.keys) if n > 0 else [F.col("sl").desc(), F.col("sc").desc(), *[F.col(k).desc() for k in self.keys]]
            nth = F.row_number().over(Window.partitionBy("file_id").orderBy(*order))
            return self._with(found.withColumn("_n", nth).where(F.col("_n") == abs(n)).drop("_n"))
        if m := re.fullmatch(r"(-?\d+)([:~])(\d+)", c):
            return self.get(line=int(m[1]), column=int(m[3]), fuzzy=m[2] == "~", innermost=m[2] == "~")
        if m := re.fullmatch(r"(-?\d+)\^", c):
            return self._statement_on(int(m[1]))
        raise ValueError(f"no criterion: {c!r}")

    def _statement_on(self, line: int) -> Search:
        """The statements of files, not of blocks in them, that cover a line; of several the first."""
        top = self._with(self.frame.where("depth = 1")).get(line=line, fuzzy=True).frame
        first = F.row_number().over(Window.partitionBy("file_id").orderBy(*_order(self.keys)))
        return self._with(top.withColumn("_n", first).where("_n = 1").drop("_n"))

    def from_ids(self, ids: DataFrame) -> Search:
        return self._with(self.frame.join(ids, self.keys, "left_semi"))

    def from_query(self, found: DataFrame, key: str = "id", data: str | None = None) -> Search:
        """The nodes that the rows of a query's result name; with `data`, these rows as an enrichment of that name."""
        ids = found.select(F.col(key).alias("node_id")).where("node_id is not null").distinct()
        out = self._with(self.frame.join(ids, "node_id", "left_semi"))
        if data is None:
            return out
        rows = found.select(F.col(key).alias("node_id"), F.to_json(F.struct(*[F.col(c) for c in found.columns if c != key])).alias("_data"))
        given = rows.groupBy("node_id").agg(F.sort_array(F.collect_list("_data")).alias(data))
        return self._with(out.frame.join(given, "node_id", "left"))

    def syntax(self, pattern: str, *captures: str) -> Search:
        """The nodes that a tree pattern captures. A pattern is `(type role: (type ...) ... "lexeme") @name`, `_` standing for
        any type; a role in front of a child is its role in the parent. Without named captures, all captured nodes."""
        wanted = _pattern(pattern)
        rows, names = _matched(wanted, self.all_nodes)
        chosen = [n for n in names if not captures or n in captures]
        ids = rows.select(F.explode(F.array(*[F.col(f"@{n}") for n in chosen])).alias("node_id")).distinct()
        return self._with(self.frame.join(ids, "node_id", "left_semi"))

    # transformers

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Search:
        """The nodes that a function of the found ones names in a column node_id, each once."""
        ids = f(self.frame).select("node_id").distinct()
        return self._with(self.nodes.dropDuplicates(self.keys).join(ids, "node_id", "left_semi"))

    def filter(self, condition: Column) -> Search:
        return self._with(self.frame.where(condition))

    def first(self) -> Search:
        return self.take(1)

    def last(self) -> Search:
        late = [F.col("sl").isNull().desc(), F.col("sl").desc(), F.col("sc").desc(), *[F.col(k).desc() for k in self.keys]]
        return self._with(self.frame.orderBy(*late).limit(1))

    def index(self, i: int) -> Search:
        return self._with(self.frame.orderBy(*_order(self.keys)).offset(i).limit(1))

    def select(self, *places: int) -> Search:
        """Nodes at places from 0; only as many rows as the largest place are sorted out."""
        top = self.frame.orderBy(*_order(self.keys)).limit(max(places, default=-1) + 1)
        numbered = top.withColumn("_i", F.row_number().over(Window.orderBy(*_order(self.keys))) - 1)
        return self._with(numbered.where(F.col("_i").isin(*places)).drop("_i"))

    def take(self, n: int) -> Search:
        return self._with(self.frame.orderBy(*_order(self.keys)).limit(n))

    def skip(self, n: int) -> Search:
        return self._with(self.frame.orderBy(*_order(self.keys)).offset(n))

    def tail(self) -> Search:
        return self.skip(1)

    def unique(self) -> Search:
        return self._with(self.frame.dropDuplicates(self.keys))

    def merge(self, other: Search) -> Search:
        return self._with(self.frame.unionByName(other.frame, allowMissingColumns=True))

    def with_(self, name: str, values: DataFrame, value: Column) -> Search:
        """An enrichment: for each node the sorted distinct values of the rows of `values` with its keys."""
        found = values.groupBy(*self.keys).agg(F.sort_array(F.collect_set(value)).alias(name))
        return self._with(self.frame.join(found, self.keys, "left"))

    def to(self, name: str, key: str = "node_id") -> Search:
        """The nodes that an enrichment names, each once."""
        ids = self.frame.select("file_id", F.explode(name).alias(key)).distinct()
        return self._with(self.nodes.dropDuplicates(self.keys).join(ids, ["file_id", key], "left_semi"))


def two_layers(calls: DataFrame, patterns: DataFrame, name: str = "name") -> DataFrame:
    """kind, subkind and the calls whose names match a pattern of it: patterns (kind, subkind, pattern, exact).

    Exact names are an equi-join; only patterns proper, a dimension of a few rows, are tried one by one.
    """
    columns = [F.col(f"c.{c}").alias(c) for c in calls.columns]
    exact = calls.alias("c").join(patterns.where("exact").alias("p"), F.col(f"c.{name}") == F.col("p.pattern"))
    tried = calls.alias("c").join(patterns.where("not exact").alias("p"), F.expr(f"c.{name} rlike p.pattern"))
    return exact.select("p.kind", "p.subkind", *columns).union(tried.select("p.kind", "p.subkind", *columns)).distinct()


def _file_filter(criterion: str) -> tuple[str, str | None]:
    m = re.fullmatch(r"([^()]*)\(((?:\\.|[^()])*)\)", criterion)
    return (m[1], m[2]) if m else (criterion, None)


class Pattern:
    """One node of a tree pattern: its type (None: any), lexeme, capture, and children with their roles."""

    def __init__(self, kind: str | None):
        self.kind, self.lexeme, self.capture = kind, None, None
        self.children: list[tuple[str | None, Pattern]] = []


def _pattern(text: str) -> Pattern:
    tokens = re.findall(r'\(|\)|"(?:\\.|[^"\\])*"|@[\w.-]+|[\w-]+:|[\w.-]+', text)
    at = 0

    def node() -> Pattern:
        nonlocal at
        if at >= len(tokens) or tokens[at] != "(":
            raise ValueError(f"expected ( in pattern {text!r}")
        out = Pattern(None if tokens[at + 1] == "_" else tokens[at + 1])
        at += 2
        role = None
        while at < len(tokens) and tokens[at] != ")":
            t = tokens[at]
            if t == "(":
                out.children.append((role, node()))
                role = None
            elif t.endswith(":"):
                role, at = t[:-1], at + 1
            elif t.startswith('"'):
                out.lexeme, at = json.loads(t), at + 1
            else:
                raise ValueError(f"unexpected {t} in pattern {text!r}")
        if at >= len(tokens):
            raise ValueError(f"unclosed pattern {text!r}")
        at += 1
        if at < len(tokens) and tokens[at].startswith("@"):
            out.capture, at = tokens[at][1:], at + 1
        return out

    found = node()
    if at != len(tokens):
        raise ValueError(f"more than one pattern in {text!r}")
    return found


def _matched(p: Pattern, nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """The matches of a pattern, one column @name for each capture: a join on the parent for each child."""
    counter, names = iter(range(1 << 30)), []

    def of(q: Pattern) -> tuple[DataFrame, str]:
        me = f"_n{next(counter)}"
        rows = nodes
        if q.kind is not None:
            rows = rows.where(F.col("type") == q.kind)
        if q.lexeme is not None:
            rows = rows.where(F.col("lexeme") == q.lexeme)
        rows = rows.select(F.col("node_id").alias(me), F.col("parent_id").alias(f"{me}_up"), F.col("role").alias(f"{me}_role"))
        if q.capture:
            names.append(q.capture)
            rows = rows.withColumn(f"@{q.capture}", F.col(me))
        for role, child in q.children:
            inner, key = of(child)
            if role is not None:
                inner = inner.where(F.col(f"{key}_role") == role)
            rows = rows.join(inner, F.col(me) == F.col(f"{key}_up")).drop(f"{key}_up", f"{key}_role")
        return rows, me

    out, me = of(p)
    if not names:
        names.append("match")
        out = out.withColumn("@match", F.col(me))
    return out.select(*[f"@{n}" for n in names]).distinct(), names
