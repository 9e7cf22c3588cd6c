"""The signature database over parts: brands are packages, sizes their versions, parts their functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import versions as V
from skein.operators.signatures import DEPRECATED, EXPORTED, S4, Signatures
from skein.plans.registry import query
from skein.session import table

_PARTS = r"""p AS (SELECT lower(replace(p_brand, '#', '')) AS pkg, p_size AS size, p_size || '.0' AS version, 'f' || (p_partkey % 50) AS name, p_type AS type, p_partkey AS k FROM part),
    v AS (SELECT DISTINCT pkg, size, version FROM p), newest AS (SELECT pkg, max(size) AS size FROM p GROUP BY 1)"""


def database(spark: SparkSession, d: str) -> Signatures:
    """Version {size}.0 of a brand was released that many days into 2020, and needs at least version 10 of the brand whose
    number is one higher, if it is above 20 itself."""
    p = table(spark, d, "part").select(
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("pkg"), F.col("p_size").alias("size"), F.concat("p_size", F.lit(".0")).alias("version"),
        F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("k"),
    )
    number = F.regexp_extract("pkg", r"(\d+)$", 1).cast("int")
    bits = F.when(F.col("type") == "ECONOMY", EXPORTED | DEPRECATED).when(F.col("type") == "SMALL", S4).otherwise(EXPORTED)
    fn = p.groupBy("pkg", "version", "name").agg(F.bit_or(bits).cast("int").alias("props"))
    callee = F.concat(F.lit("f"), F.regexp_extract("name", r"(\d+)$", 1).cast("int") + 10)
    versions = p.select("pkg", "size", "version").distinct()
    return Signatures(
        versions.select("pkg", "version", F.date_add(F.lit("2020-01-01").cast("date"), F.col("size")).alias("released")), fn,
        fn.select("pkg", "version", "name", F.lit("x").alias("param"), F.lit(0).alias("idx"), F.lit(True).alias("required")), fn.select("pkg", "version", "name", callee.alias("callee")),
        versions.where("size > 20").select("pkg", "version", F.concat(F.lit("brand"), number + 1).alias("dep"), F.lit("Imports").alias("type"), F.lit(">= 10").alias("constraint")),
    )


@query(f"WITH {_PARTS} SELECT pkg, count(*) AS versions, max(size) || '.0' AS newest FROM v GROUP BY pkg")
def signature_packages(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).packages("brand*")


@query(f"WITH {_PARTS} SELECT pkg, max(size) || '.0' AS version FROM v WHERE pkg = 'brand3' AND size <= 30 GROUP BY pkg")
def signature_version_at(spark: SparkSession, d: str) -> DataFrame:
    """The highest version of a package that was released by a date."""
    return database(spark, d).version("brand3", "2020-01-31")


@query(f"WITH {_PARTS} SELECT DISTINCT p.pkg, p.version, p.name, 1 AS params, 1 AS required FROM p JOIN newest n ON p.pkg = n.pkg AND p.size = n.size")
def signature_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions of newest versions, with their parameters."""
    return database(spark, d).functions("brand*").select("pkg", "version", "name", F.size("params").alias("params"), "required")


@query(
    f"""WITH {_PARTS}, x AS (SELECT DISTINCT pkg, version, name, type FROM p),
    e AS (SELECT pkg, version, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (type <> 'SMALL') AS exported, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (type = 'ECONOMY') AS deprecated FROM x GROUP BY 1, 2)
    SELECT pkg, version, coalesce(exported, '') AS exported, coalesce(deprecated, '') AS deprecated FROM e"""
)
def signature_exports(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).exports().select("pkg", "version", F.array_join("exported", ",").alias("exported"), F.array_join("deprecated", ",").alias("deprecated"))


@query(f"WITH {_PARTS} SELECT name, string_agg(DISTINCT pkg, ',' ORDER BY pkg) AS packages FROM p WHERE type <> 'SMALL' GROUP BY name")
def signature_owners(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).owners().select("name", F.array_join("packages", ",").alias("packages"))


@query(f"WITH {_PARTS} SELECT name, string_agg(DISTINCT pkg, ',' ORDER BY pkg) AS packages FROM p WHERE type = 'SMALL' GROUP BY name")
def signature_class_owners(spark: SparkSession, d: str) -> DataFrame:
    return database(spark, d).class_owners().select("name", F.array_join("packages", ",").alias("packages"))


@query(
    f"""WITH RECURSIVE {_PARTS}, f AS (SELECT DISTINCT pkg, version, name, 'f' || (CAST(substr(name, 2) AS INTEGER) + 10) AS callee FROM p),
    one AS (SELECT pkg, version FROM f ORDER BY pkg, version LIMIT 1), r(callee) AS (SELECT callee FROM f SEMI JOIN one USING (pkg, version) WHERE name = (SELECT min(name) FROM f SEMI JOIN one USING (pkg, version))
      UNION SELECT f.callee FROM r JOIN f ON f.name = r.callee SEMI JOIN one ON f.pkg = one.pkg AND f.version = one.version) SELECT callee FROM r"""
)
def signature_callees(spark: SparkSession, d: str) -> DataFrame:
    """All that the first function of the first package's first version calls."""
    db = database(spark, d)
    first = db.fn.orderBy("pkg", "version", "name").first()
    return db.callees(first.pkg, first.name if isinstance(first.name, str) else first["name"], first.version)


_FEASIBLE = f"""{_PARTS}, want AS (SELECT DISTINCT pkg, size, version FROM p WHERE pkg = 'brand3' AND size >= 5),
    dep AS (SELECT DISTINCT pkg, size, version FROM p WHERE pkg = 'brand4'), """


def _feasible(spark: SparkSession, d: str) -> tuple[Signatures, DataFrame]:
    db = database(spark, d)
    # without further needs of the needed one
    db.pkg_dep = db.pkg_dep.where("pkg = 'brand3'")
    return db, db.feasible(spark.createDataFrame([("brand3", ">= 5")], "pkg string, constraint string"))


@query(f"WITH {_FEASIBLE} ok AS (SELECT 1) SELECT pkg, version FROM want WHERE size <= 20 OR EXISTS (SELECT 1 FROM dep d WHERE d.size >= 10) UNION ALL SELECT pkg, version FROM dep")
def signature_feasible(spark: SparkSession, d: str) -> DataFrame:
    """Versions that a constraint and the needs among packages leave."""
    return _feasible(spark, d)[1]


@query(f"WITH {_FEASIBLE} a AS (SELECT * FROM want UNION ALL SELECT * FROM dep) SELECT pkg, min(size) || '.0' AS lowest, max(size) || '.0' AS highest, count(*) AS versions FROM a GROUP BY pkg")
def signature_ranges(spark: SparkSession, d: str) -> DataFrame:
    db, found = _feasible(spark, d)
    return db.ranges(found)


@query(f"WITH {_FEASIBLE} a AS (SELECT * FROM want UNION ALL SELECT * FROM dep), r AS (SELECT pkg, version, row_number() OVER (PARTITION BY pkg ORDER BY size DESC) AS place FROM a) SELECT pkg, version, place FROM r WHERE place <= 3")
def signature_candidates(spark: SparkSession, d: str) -> DataFrame:
    db, found = _feasible(spark, d)
    return db.candidates(found, 3).select("pkg", "version", F.col("place").cast("long").alias("place"))


@query(f"WITH {_FEASIBLE} a AS (SELECT count(*) AS n FROM want), b AS (SELECT count(*) AS n FROM dep) SELECT CAST(a.n * b.n AS VARCHAR) AS combinations FROM a, b")
def signature_combinations(spark: SparkSession, d: str) -> DataFrame:
    db, found = _feasible(spark, d)
    return db.combinations(found).select(F.col("combinations").cast("string").alias("combinations"))


@query(f"WITH {_FEASIBLE} x AS (SELECT 1) SELECT w.version, d.version AS dep_version FROM want w JOIN dep d ON d.size >= 10 WHERE w.size > 20")
def signature_coinstallable(spark: SparkSession, d: str) -> DataFrame:
    db, found = _feasible(spark, d)
    return db.coinstallable(found).select("version", "dep_version")


@query(
    f"""WITH {_FEASIBLE} x AS (SELECT w.version AS brand3, d.version AS brand4, w.size AS a, d.size AS b FROM want w JOIN dep d ON d.size >= 10 WHERE w.size > 20)
    SELECT brand3, brand4 FROM x ORDER BY a DESC, b DESC LIMIT 5"""
)
def signature_explode(spark: SparkSession, d: str) -> DataFrame:
    """The five newest ways to choose the versions of two packages of which one needs the other."""
    db, found = _feasible(spark, d)
    return db.explode(found.where("pkg <> 'brand3' or cast(split(version, '[.]')[0] as int) > 20"), ["brand3", "brand4"], 5)


@query(
    f"""WITH {_PARTS} SELECT pkg, 'constraint' AS source, '>= 5, < 40' AS detail, min(size) || '.0' AS lowest, max(size) || '.0' AS highest FROM v WHERE pkg = 'brand3' AND size >= 5 AND size < 40 GROUP BY pkg
    UNION ALL SELECT pkg, 'signature', name, min(size) || '.0', max(size) || '.0' FROM p WHERE pkg = 'brand3' GROUP BY pkg, name"""
)
def signature_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What bounds a package's versions: the declared constraint, and each function's first and last version."""
    db = database(spark, d)
    return db.evidence(spark.createDataFrame([("brand3", ">= 5, < 40")], "pkg string, constraint string"), db.fn.where("pkg = 'brand3'").select("pkg", "name").distinct())


@query(
    f"""WITH {_PARTS}, x AS (SELECT p.pkg, p.name, bool_or(type <> 'SMALL') AS e, bool_or(type = 'ECONOMY') AS d, bool_or(type = 'SMALL') AS s FROM p JOIN newest n ON p.pkg = n.pkg AND p.size = n.size GROUP BY 1, 2)
    SELECT name, pkg, concat_ws(',', CASE WHEN e THEN 'exported' END, CASE WHEN d THEN 'deprecated' END, CASE WHEN s THEN 's4' END) AS properties FROM x"""
)
def signature_properties(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    return db.properties(db.fn.select("name")).select("name", "pkg", F.array_join("properties", ",").alias("properties"))


@query(f"WITH {_PARTS} SELECT pkg, name, string_agg(DISTINCT type, ',' ORDER BY type) AS arguments FROM p GROUP BY 1, 2")
def signature_usage(spark: SparkSession, d: str) -> DataFrame:
    """Which arguments the calls of each function give; here the types of a brand's parts."""
    calls = table(spark, d, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("pkg"), F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("name"), F.col("p_type").alias("argument"))
    return database(spark, d).usage(calls).select("pkg", "name", F.array_join("arguments", ",").alias("arguments"))


@query(f"WITH {_PARTS} SELECT pkg, CASE WHEN pkg LIKE '%1' THEN 1 ELSE count(*) END AS versions FROM v GROUP BY pkg")
def signature_merged(spark: SparkSession, d: str) -> DataFrame:
    """Of two sources the first that has a package wins."""
    db = database(spark, d)
    names = [r.pkg for r in db.pkg_version.select("pkg").distinct().where("pkg like '%1'").collect()]
    own = Signatures.of(spark, pkg_version=[(n, "99.0", None) for n in names])
    return Signatures.merged(own, db).packages().select("pkg", "versions")


@query(f"WITH {_PARTS} SELECT pkg, count(*) AS versions FROM v GROUP BY pkg")
def signature_written(spark: SparkSession, d: str) -> DataFrame:
    """The database written by shard and read back."""
    from skein.storage import shared_dir

    path = f"{shared_dir(spark)}/skein-signatures-{abs(hash(d))}"
    database(spark, d).write(path, 4)
    return Signatures.read(spark, path).packages().select("pkg", "versions")


@query(
    """SELECT p_partkey, '>= ' || (p_size % 10) || ', < ' || (p_size % 7) AS both, p_size % 10 >= p_size % 7 AS none, p_size % 10 <= 5 AND 5 < p_size % 7 AS five, p_size % 10 <= 5 OR 5 < p_size % 7 AS either FROM part"""
)
def version_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Two constraints as one, whether any version can meet it, and whether one version meets both or either."""
    a, b = F.concat(F.lit(">= "), F.col("p_size") % 10), F.concat(F.lit("< "), F.col("p_size") % 7)
    both, five = V.intersect(a, b), F.lit("5.0")
    return table(spark, d, "part").select("p_partkey", both.alias("both"), V.empty(both).alias("none"), V.satisfies(five, both).alias("five"), V.satisfies_any(five, F.array(a, b)).alias("either"))
