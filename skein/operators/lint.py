"""Lint rules as joins. Findings have rule, certainty (certain or uncertain), and what the rule is about."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The casings that names are sorted into, by pattern, the first that fits.
CASINGS = {
    "flatcase": r"^[a-z0-9]+$", "MACRO_CASE": r"^[A-Z0-9]+(_[A-Z0-9]+)*$", "snake_case": r"^[a-z0-9]+(_[a-z0-9]+)+$",
    "camelCase": r"^[a-z]+[a-zA-Z0-9]*$", "PascalCase": r"^[A-Z][a-zA-Z0-9]*$", "period.case": r"^[a-z0-9]+(\.[a-z0-9]+)+$",
}
#: Names of things that hold secrets, and known forms of secrets.
SECRET_NAMES = r"(?i)(passw(or)?d|secret|token|api[._-]?key|credential)"
SECRET_FORMS = {
    "aws": r"\bAKIA[0-9A-Z]{16}\b", "github": r"\bgh[pousr]_[A-Za-z0-9]{36}", "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", "ssh": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "assigned": r"(?i)\b(?:passw(?:or)?d|secret|token|api[._-]?key)\s*(?:=|<-|:)\s*[\"'][^\"']{4,}[\"']",
}


#: Texts of which a form has one at least: looked for first, as plain search is much cheaper than a pattern. Lower-case
#: ones are looked for whatever the letters' case.
GUARDS = {
    "aws": ("AKIA",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack": ("xox",), "stripe": ("k_live_", "k_test_"), "ssh": ("PRIVATE KEY-----",),
    "assigned": ("passw", "secret", "token", "api"),
}


def unused(definitions: DataFrame, reads: DataFrame, key: str) -> DataFrame:
    """Definitions that nothing reads."""
    return definitions.join(reads.select(key).distinct(), key, "left_anti")


def outermost(findings: DataFrame, file: str = "file_id") -> DataFrame:
    """Findings that no other one of their file strictly contains. A sort in place of a self-join: in the order of
    starts, the longer first, a range is inside an earlier one exactly if its end is no further than the furthest."""
    w = Window.partitionBy(file).orderBy("sl", "sc", F.col("el").desc(), F.col("ec").desc()).rowsBetween(Window.unboundedPreceding, -1)
    end = F.struct("el", "ec")
    far = findings.withColumn("_far", F.max(end).over(w))
    return far.where(F.col("_far").isNull() | (end > F.col("_far"))).drop("_far")


def undefined(uses: DataFrame, reasons: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """uses with the first reason (name, table of keys) that explains them; null for undefined ones."""
    out, cols = uses, []
    for i, (name, known) in enumerate(reasons):
        out = out.join(known.select(key).distinct().withColumn(f"_{i}", F.lit(True)), key, "left")
        cols.append(F.when(F.col(f"_{i}"), F.lit(name)))
    return out.withColumn("reason", F.coalesce(*cols)).drop(*[f"_{i}" for i in range(len(cols))])


def every_branch(dependencies: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, covered: whether control dependencies (id, when) of a key hold in every branch: with each one also its
    opposite."""
    each = dependencies.groupBy(*key, "id").agg((F.bool_or("when") & F.bool_or(~F.col("when"))).alias("_both"))
    return each.groupBy(*key).agg(F.bool_and("_both").alias("covered"))


def unguarded(calls: DataFrame, consumer: Column, producer: Column, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Consumers without an earlier producer in their group, such as random calls without a seed."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("_seen", F.max(producer).over(w)).where(consumer & ~F.coalesce("_seen", F.lit(False))).drop("_seen")


def unclosed(calls: DataFrame, opens: Column, closes: Column, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Opening calls after which their group has no closing one before the next opening, or at all."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    after = F.when(closes, F.lit(True)).when(opens, F.lit(False))
    return calls.withColumn("_next", F.first(after, ignorenulls=True).over(w)).where(opens & ~F.coalesce("_next", F.lit(False))).drop("_next")


def casing(name: Column) -> Column:
    out = None
    for label, pattern in CASINGS.items():
        out = F.when(name.rlike(pattern), label) if out is None else out.when(name.rlike(pattern), label)
    return out.otherwise("unknown")


def naming(names: DataFrame, column: str, by: Sequence[str] = (), expected: str | None = None) -> DataFrame:
    """Names whose casing is not the commonest of their group, or not the expected one: with casing and expected. One
    distinct name counts once; of equally common casings the last by name."""
    cased = names.withColumn("casing", casing(F.col(column)))
    if expected is not None:
        return cased.withColumn("expected", F.lit(expected)).where("casing <> expected")
    common = cased.where("casing <> 'unknown'").groupBy(*by, "casing").agg(F.count("*").alias("n"))
    # one row without groups, one for each group with them
    best = common.groupBy(*by).agg(F.max_by("casing", F.struct("n", "casing")).alias("expected"))
    return (cased.join(best, list(by)) if by else cased.crossJoin(F.broadcast(best))).where("casing <> expected")


def deprecated(calls: DataFrame, table: DataFrame, name: str = "name", version: Column | None = None) -> DataFrame:
    """Calls of deprecated functions: table (name, since), since null for always; `version` in use."""
    from skein.functions import versions as V

    out = calls.join(table, name)
    return out if version is None else out.where(F.col("since").isNull() | (V.parse(version) >= V.parse(F.col("since"))))


def secrets(texts: DataFrame, column: str) -> DataFrame:
    """texts with the first known form of a secret in them."""
    out, low = None, F.lower(column)
    for label, pattern in SECRET_FORMS.items():
        where = low if pattern.startswith("(?i)") else F.col(column)
        guard = reduce(or_, [where.contains(x) for x in GUARDS[label]])
        hit = guard & F.col(column).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return texts.withColumn("form", out).where("form is not null")


def missing(documented: DataFrame, declared: DataFrame, key: Sequence[str], name: str = "param") -> DataFrame:
    """key, name, side: parameters that only the documentation or only the declaration has."""
    a, b = documented.select(*key, name, F.lit(True).alias("_a")), declared.select(*key, name, F.lit(True).alias("_b"))
    both = a.join(b, [*key, name], "full").where("_a is null or _b is null")
    return both.select(*key, name, F.when(F.col("_a").isNull(), "undocumented").otherwise("undeclared").alias("side"))


def absent(rows: DataFrame, rule: str) -> DataFrame:
    """One finding of the rule if there are no rows at all."""
    return rows.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(rule).alias("rule"), F.lit("certain").alias("certainty"))


def invalid_access(accesses: DataFrame, schema: DataFrame, frame: str = "frame") -> DataFrame:
    """Accesses (frame, column or row) to columns that the frame lacks, or rows beyond its last: schema (frame, columns,
    rows), null where unknown."""
    out = accesses.join(schema, frame)
    column = F.col("column").isNotNull() & ~F.array_contains("columns", F.col("column"))
    row = F.col("row").isNotNull() & (F.col("row") > F.col("rows"))
    return out.where(F.coalesce(column, F.lit(False)) | F.coalesce(row, F.lit(False))).select(*accesses.columns)


def useless_loops(loops: DataFrame) -> DataFrame:
    """Loops over at most one element, or whose every branch leaves: loops (elements, leaves_always)."""
    return loops.where((F.col("elements") <= 1) | F.coalesce("leaves_always", F.lit(False)))


def problematic(calls: DataFrame, inputs: DataFrame, names: Sequence[str], key: str = "call_id") -> DataFrame:
    """Calls of the named functions with an input that is not constant: inputs (key, kind)."""
    bad = inputs.where(~F.col("kind").isin("const", "dconst")).groupBy(key).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return calls.where(F.col("name").isin(*names)).join(bad, key)
