"""The signature database as a star of tables, look-ups in it, and solving for package versions.

pkg_version (pkg, version, released), fn (pkg, version, name, props), fn_param (pkg, version, name, param, idx, required),
fn_callee (pkg, version, name, callee), pkg_dep (pkg, version, dep, type, constraint).
"""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import versions as V
from skein.operators import graph as G
from skein.storage import stored

#: Bits of fn.props.
EXPORTED, INTERNAL, DEPRECATED, S3, S4 = (1 << i for i in range(5))
SCHEMAS = {
    "pkg_version": "pkg string, version string, released date", "fn": "pkg string, version string, name string, props int",
    "fn_param": "pkg string, version string, name string, param string, idx int, required boolean",
    "fn_callee": "pkg string, version string, name string, callee string", "pkg_dep": "pkg string, version string, dep string, type string, constraint string",
}


def _glob(column: str, pattern: str | None) -> Column:
    """Names that match a glob; plain names are equalities, which reach the scan."""
    if pattern is None:
        return F.lit(True)
    if any(c in pattern for c in "*?["):
        return F.col(column).rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$"))
    return F.col(column) == pattern


@dataclass
class Signatures:
    pkg_version: DataFrame
    fn: DataFrame
    fn_param: DataFrame
    fn_callee: DataFrame
    pkg_dep: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **rows: list[tuple]) -> Signatures:
        """From rows in memory."""
        return cls(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Signatures:
        """From write(): only the partitions of the packages asked for are read."""
        return cls(**{name: spark.read.schema(schema + ", shard int").parquet(f"{path}/{name}").drop("shard") for name, schema in SCHEMAS.items()})

    def write(self, path: str, shards: int = 16) -> None:
        for name in SCHEMAS:
            rows = getattr(self, name).withColumn("shard", F.pmod(F.xxhash64("pkg"), F.lit(shards)).cast("int"))
            rows.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/{name}")

    @staticmethod
    def merged(*sources: Signatures) -> Signatures:
        """The first source that has a package wins, for all of its tables."""
        owner = None
        for i, s in enumerate(sources):
            one = s.pkg_version.select("pkg").distinct().withColumn("source", F.lit(i))
            owner = one if owner is None else owner.union(one)
        first = owner.groupBy("pkg").agg(F.min("source").alias("source"))
        out = {}
        for name in SCHEMAS:
            rows = None
            for i, s in enumerate(sources):
                one = getattr(s, name).join(first.where(F.col("source") == i).select("pkg"), "pkg", "left_semi")
                rows = one if rows is None else rows.unionByName(one)
            out[name] = rows
        return Signatures(**out)

    # look-ups

    def packages(self, pattern: str | None = None) -> DataFrame:
        """pkg, versions, newest."""
        found = self.pkg_version.where(_glob("pkg", pattern))
        return found.groupBy("pkg").agg(F.count("*").alias("versions"), V.highest(F.col("version")).alias("newest"))

    def version(self, package: str, at: str | None = None) -> DataFrame:
        """The highest version of a package, or the highest released by a date."""
        rows = self.pkg_version.where(F.col("pkg") == package)
        rows = rows if at is None else rows.where(F.col("released") <= F.lit(at).cast("date"))
        return rows.groupBy("pkg").agg(V.highest(F.col("version")).alias("version"))

    def newest(self) -> DataFrame:
        return self.pkg_version.groupBy("pkg").agg(V.highest(F.col("version")).alias("version"))

    def functions(self, package: str | None = None, function: str | None = None, version: str | None = None) -> DataFrame:
        """Functions of the given version, or of each package's newest one, with their parameters in order."""
        rows = self.fn.where(_glob("pkg", package) & _glob("name", function))
        rows = rows.join(self.newest(), ["pkg", "version"], "left_semi") if version is None else rows.where(F.col("version") == version)
        params = self.fn_param.groupBy("pkg", "version", "name").agg(F.sort_array(F.collect_list(F.struct("idx", "param", "required"))).alias("params"))
        return rows.join(params, ["pkg", "version", "name"], "left").withColumn("required", F.size(F.filter("params", lambda x: x["required"])))

    def exports(self) -> DataFrame:
        """pkg, version and the sorted names by kind."""
        named = lambda bit: F.sort_array(F.collect_set(F.when(F.col("props").bitwiseAND(F.lit(bit)) != 0, F.col("name"))))
        kinds = {"exported": EXPORTED, "internal": INTERNAL, "deprecated": DEPRECATED, "s3": S3, "s4": S4}
        return self.fn.groupBy("pkg", "version").agg(*[named(bit).alias(k) for k, bit in kinds.items()])

    def owners(self) -> DataFrame:
        """name, packages: who exports a function."""
        return self.fn.where(F.col("props").bitwiseAND(F.lit(EXPORTED)) != 0).groupBy("name").agg(F.sort_array(F.collect_set("pkg")).alias("packages"))

    def callees(self, package: str, function: str, version: str) -> DataFrame:
        """All functions that a function calls inside its package, directly or not."""
        edges = self.fn_callee.where((F.col("pkg") == package) & (F.col("version") == version)).select(F.col("name").alias("src"), F.col("callee").alias("dst"))
        seeds = edges.where(F.col("src") == function).select(F.col("dst").alias("id"))
        return G.closure(edges, seeds).select(F.col("id").alias("callee")).distinct()

    # versions

    def feasible(self, wanted: DataFrame, used: DataFrame | None = None, date: str | None = None, rounds: int = 8) -> DataFrame:
        """pkg, version that may be installed together: wanted (pkg, constraint) holds, every used function (pkg, name) is
        there, released by the date, and every dependency has a feasible version (arc consistency, to a fixpoint or for
        so many rounds). Packages that wanted ones need are solved too; packages without any known version are left out of
        the account.
        """
        versions = self.pkg_version if date is None else self.pkg_version.where(F.col("released") <= F.lit(date).cast("date"))
        known = self.pkg_version.select("pkg").distinct()
        needs = self.pkg_dep.where("type in ('Depends', 'Imports', 'LinkingTo')").join(known.withColumnRenamed("pkg", "dep"), "dep", "left_semi")
        edges = needs.select(F.col("pkg").alias("src"), F.col("dep").alias("dst"))
        members = G.closure(edges, wanted.select(F.col("pkg").alias("id"))).select(F.col("id").alias("pkg")).distinct()
        now = versions.select("pkg", "version").join(members, "pkg", "left_semi")
        bound = wanted.where("constraint is not null").select("pkg", "constraint")
        bad = now.join(bound, "pkg").where(~V.satisfies(F.col("version"), F.col("constraint"))).select("pkg", "version")
        now = now.join(bad.distinct(), ["pkg", "version"], "left_anti")
        if used is not None:
            asked = used.join(known, "pkg", "left_semi").distinct()
            lacking = now.join(asked, "pkg").join(self.fn.select("pkg", "version", "name"), ["pkg", "version", "name"], "left_anti").select("pkg", "version")
            now = now.join(lacking.distinct(), ["pkg", "version"], "left_anti")
        now = stored(now, "feasible")
        needs = stored(needs.join(members, "pkg", "left_semi"), "needs")
        ok = F.coalesce(V.satisfies(F.col("have"), F.coalesce("constraint", F.lit(""))), F.lit(True))
        for _ in range(rounds):
            have = now.select(F.col("pkg").alias("dep"), F.col("version").alias("have"))
            asks = needs.join(now, ["pkg", "version"], "left_semi")
            served = asks.join(have, "dep").where(ok).select("pkg", "version", "dep").distinct()
            stuck = asks.join(served, ["pkg", "version", "dep"], "left_anti").select("pkg", "version").distinct()
            after = stored(now.join(stuck, ["pkg", "version"], "left_anti"), "feasible")
            same = after.count() == now.count()
            now = after
            if same:
                break
        return now

    def candidates(self, feasible: DataFrame, most: int = 10) -> DataFrame:
        """pkg, version, place: feasible versions, newest first."""
        place = F.row_number().over(Window.partitionBy("pkg").orderBy(V.parse(F.col("version")).desc()))
        return feasible.withColumn("place", place).where(F.col("place") <= most)

    def ranges(self, feasible: DataFrame) -> DataFrame:
        """pkg, lowest, highest, versions."""
        low = F.min_by("version", V.parse(F.col("version")))
        return feasible.groupBy("pkg").agg(low.alias("lowest"), V.highest(F.col("version")).alias("highest"), F.count("*").alias("versions"))

    def combinations(self, feasible: DataFrame) -> DataFrame:
        """The number of ways to choose a version of each package, couplings aside: an upper bound."""
        each = feasible.groupBy("pkg").agg(F.count("*").alias("n"))
        return each.agg(F.round(F.exp(F.sum(F.ln("n")))).cast("decimal(38,0)").alias("combinations"))

    def coinstallable(self, feasible: DataFrame) -> DataFrame:
        """pkg, version, dep, dep_version: versions of packages that need one another and fit together."""
        have = feasible.select(F.col("pkg").alias("dep"), F.col("version").alias("dep_version"))
        needs = self.pkg_dep.where("type in ('Depends', 'Imports', 'LinkingTo')").join(feasible, ["pkg", "version"], "left_semi").join(have, "dep")
        ok = F.coalesce(V.satisfies(F.col("dep_version"), F.coalesce("constraint", F.lit(""))), F.lit(True))
        every = needs.groupBy("pkg", "version", "dep", "dep_version").agg(F.bool_and(ok).alias("ok"))
        return every.where("ok").drop("ok")

    def explode(self, feasible: DataFrame, packages: Sequence[str], most: int = 256) -> DataFrame:
        """One column for each of the packages: up to `most` ways to choose their versions together, newest first. Packages
        are joined one after the other; those that need one another only in versions that fit."""
        fits, out, done = self.coinstallable(feasible), None, []
        couples = {(r.pkg, r.dep) for r in fits.select("pkg", "dep").where(F.col("pkg").isin(*packages) & F.col("dep").isin(*packages)).distinct().collect()}
        for p in packages:
            mine = feasible.where(F.col("pkg") == p).select(F.col("version").alias(p))
            links = [q for q in done if (p, q) in couples or (q, p) in couples]
            if out is None:
                out = mine
            elif not links:
                # nothing couples them: every choice goes with every other, as many as are asked for
                out = out.crossJoin(mine.orderBy(V.parse(F.col(p)).desc()).limit(most))
            for q in links:
                a, b = (p, q) if (p, q) in couples else (q, p)
                pair = fits.where((F.col("pkg") == a) & (F.col("dep") == b)).select(F.col("version").alias(a), F.col("dep_version").alias(b))
                out = out.join(pair, [c for c in (a, b) if c in out.columns])
            done.append(p)
            out = out.orderBy(*[V.parse(F.col(c)).desc() for c in out.columns]).limit(most)
        return out.select(*packages)

    def evidence(self, wanted: DataFrame, used: DataFrame | None = None) -> DataFrame:
        """pkg, source, detail, lowest, highest: what bounds a package's versions: declared constraints, and the first and
        last version that has a used function (pkg, name)."""
        v = self.pkg_version.select("pkg", "version")
        edge = (F.min_by("version", V.parse(F.col("version"))).alias("lowest"), V.highest(F.col("version")).alias("highest"))
        bound = wanted.where("constraint is not null").select("pkg", "constraint").distinct()
        declared = v.join(bound, "pkg").where(V.satisfies(F.col("version"), F.col("constraint"))).groupBy("pkg", F.lit("constraint").alias("source"), F.col("constraint").alias("detail")).agg(*edge)
        if used is None:
            return declared
        have = self.fn.join(used.select("pkg", "name").distinct(), ["pkg", "name"], "left_semi")
        return declared.union(have.groupBy("pkg", F.lit("signature").alias("source"), F.col("name").alias("detail")).agg(*edge))

    def properties(self, names: DataFrame) -> DataFrame:
        """name, pkg, properties: what the newest versions' functions of these names (name) are."""
        kinds = {"exported": EXPORTED, "internal": INTERNAL, "deprecated": DEPRECATED, "s3": S3, "s4": S4}
        rows = self.fn.join(names.select("name").distinct(), "name", "left_semi").join(self.newest(), ["pkg", "version"], "left_semi")
        listed = F.filter(F.array(*[F.when(F.col("props").bitwiseAND(F.lit(bit)) != 0, F.lit(k)) for k, bit in kinds.items()]), lambda x: x.isNotNull())
        return rows.select("name", "pkg", listed.alias("properties"))

    def class_owners(self) -> DataFrame:
        """name, packages: which packages define a class of that name."""
        return self.fn.where(F.col("props").bitwiseAND(F.lit(S4)) != 0).groupBy("name").agg(F.sort_array(F.collect_set("pkg")).alias("packages"))

    def usage(self, calls: DataFrame) -> DataFrame:
        """pkg, name, arguments: which arguments calls (pkg, name, argument) give to each function that is known."""
        known = calls.join(self.fn.select("pkg", "name").distinct(), ["pkg", "name"], "left_semi")
        return known.groupBy("pkg", "name").agg(F.sort_array(F.collect_set("argument")).alias("arguments"))
