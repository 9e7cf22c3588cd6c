"""Formats of project files: files are written from the star schema's rows and read back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.analysis import filled
from skein.plans.registry import query
from skein.session import table
from skein.sources import files as S


def _parts(spark: SparkSession, d: str, template: str, **more: Column) -> DataFrame:
    """path, content: a file for each part. {k} is the part's number, {size} its size, {brand} the number of its brand."""
    k, size = F.col("p_partkey"), F.col("p_size")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1)
    content = filled(template, k=k, size=size, brand=brand, type=F.lower("p_type"), **more)
    return table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("path"), content.alias("content"))


_P = r"p AS (SELECT 'p' || p_partkey AS path, p_partkey AS k, p_size AS size, CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) AS brand, lower(p_type) AS type FROM part)"
DESCRIPTION = """Package: part{k}
Version: {size}.{brand}
Title: A part of
    two lines
Depends: R (>= 3.{size}), base{brand}
Imports: alpha (>= {size}), beta,
    gamma (< 2.{brand})
License: MIT + file LICENSE | GPL-{brand}
Authors@R: c(person("Ada", "Part{k}", email = "p{k}@example.org", role = c("aut", "cre")), person(given = "Bo", family = "Lee", role = "ctb"))
"""


@query(f"WITH {_P} SELECT path, key, value FROM p, LATERAL (VALUES ('Package', 'part' || k), ('Version', size || '.' || brand), ('Title', 'A part of two lines')) t(key, value)")
def source_description(spark: SparkSession, d: str) -> DataFrame:
    """Fields, continuation lines joined."""
    return S.dcf(_parts(spark, d, DESCRIPTION)).where("key in ('Package', 'Version', 'Title')").select("path", "key", "value")


@query(
    f"""WITH {_P} SELECT path, type, package, "constraint" FROM (SELECT path, size, brand FROM p), LATERAL (VALUES ('Depends', 'R', '>= 3.' || size), ('Depends', 'base' || brand, NULL),
    ('Imports', 'alpha', '>= ' || size), ('Imports', 'beta', NULL), ('Imports', 'gamma', '< 2.' || brand)) t(type, package, "constraint")"""
)
def source_description_versions(spark: SparkSession, d: str) -> DataFrame:
    """What packages a description asks for, in which versions."""
    return S.dependencies(S.dcf(_parts(spark, d, DESCRIPTION)))


@query(f"WITH {_P} SELECT path, license FROM p, LATERAL (VALUES ('MIT'), ('file LICENSE'), ('GPL-' || brand)) t(license)")
def source_licenses(spark: SparkSession, d: str) -> DataFrame:
    return S.licenses(S.dcf(_parts(spark, d, DESCRIPTION)))


@query(f"WITH {_P} SELECT path, name, email, roles FROM p, LATERAL (VALUES ('Ada Part' || k, 'p' || k || '@example.org', 'aut,cre'), ('Bo Lee', NULL, 'ctb')) t(name, email, roles)")
def source_authors(spark: SparkSession, d: str) -> DataFrame:
    return S.authors(S.dcf(_parts(spark, d, DESCRIPTION))).select("path", "name", "email", F.array_join("roles", ",").alias("roles"))


@query(
    f"""WITH {_P} SELECT path, 'part' || k AS name, size || '.' || brand AS version, 'A part of two lines' AS title, 2 AS authors FROM p"""
)
def source_description_meta(spark: SparkSession, d: str) -> DataFrame:
    """A project's name, version, title and number of authors."""
    return S.meta(_parts(spark, d, DESCRIPTION)).select("path", "name", "version", "title", "authors")


NAMESPACE = "# made\nexport(f{k}, g{brand})\nexportPattern(\"^[a-m]\")\nimportFrom(stats, sd, var{size})\nimport(utils)\nS3method(print, part{k})\n"


@query(
    f"""WITH {_P} SELECT path, directive, args FROM p, LATERAL (VALUES ('export', 'f' || k || ',g' || brand), ('exportPattern', '^[a-m]'), ('importFrom', 'stats,sd,var' || size),
    ('import', 'utils'), ('S3method', 'print,part' || k)) t(directive, args)"""
)
def source_namespace(spark: SparkSession, d: str) -> DataFrame:
    return S.namespace(_parts(spark, d, NAMESPACE)).select("path", "directive", F.array_join("args", ",").alias("args"))


@query(f"WITH {_P} SELECT path, package, names FROM p, LATERAL (VALUES ('stats', 'sd,var' || size), ('utils', '')) t(package, names)")
def source_namespace_versions(spark: SparkSession, d: str) -> DataFrame:
    """The packages that a namespace file imports, and the names it wants of them."""
    return S.namespace_imports(S.namespace(_parts(spark, d, NAMESPACE))).select("path", "package", F.array_join("names", ",").alias("names"))


NEWS = "# part{k} {size}.1\n\n* one for {brand}\n* two\n\n# part{k} {size}.0\n- first\n"


@query(f"WITH {_P} SELECT path, version, entry FROM p, LATERAL (VALUES (size || '.1', 'one for ' || brand), (size || '.1', 'two'), (size || '.0', 'first')) t(version, entry)")
def source_news(spark: SparkSession, d: str) -> DataFrame:
    return S.news(_parts(spark, d, NEWS))


RMD = "---\ntitle: t\n---\ntext\n\n```{r setup, echo=FALSE}\nx <- {k}\n```\n\nmore\n\n```{python}\ny = {size}\n```\n"


@query(f"WITH {_P} SELECT path, chunk, line, engine, options, code FROM p, LATERAL (VALUES (0, 7, 'r', 'setup, echo=FALSE', 'x <- ' || k || chr(10)), (1, 13, 'python', '', 'y = ' || size || chr(10))) t(chunk, line, engine, options, code)")
def source_rmarkdown(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of R Markdown, with where their code begins."""
    return S.rmarkdown(_parts(spark, d, RMD))


QMD = "```{r}\n#| label: fig-{size}\n#| echo: false\nplot({k})\n```\n"


@query(f"WITH {_P} SELECT path, key, value FROM p, LATERAL (VALUES ('label', 'fig-' || size), ('echo', 'false')) t(key, value)")
def source_quarto(spark: SparkSession, d: str) -> DataFrame:
    """The options that Quarto's chunks have in comments."""
    return S.chunk_options(S.rmarkdown(_parts(spark, d, QMD))).select("path", "key", "value")


RNW = "\\documentclass{article}\n<<a{k}, fig=TRUE>>=\nx <- {size}\n@\ntext\n<<>>=\ny <- {brand}\n@\n"


@query(f"WITH {_P} SELECT path, chunk, options, code FROM p, LATERAL (VALUES (0, 'a' || k || ', fig=TRUE', 'x <- ' || size || chr(10)), (1, '', 'y <- ' || brand || chr(10))) t(chunk, options, code)")
def source_sweave(spark: SparkSession, d: str) -> DataFrame:
    return S.sweave(_parts(spark, d, RNW))


IPYNB = json.dumps({"cells": [{"cell_type": "markdown", "source": "# {k}"}, {"cell_type": "code", "source": ["x <- {k}\n", "print(x)"]}, {"cell_type": "code", "source": "y <- {size}"}]})


@query(f"WITH {_P} SELECT path, chunk, code FROM p, LATERAL (VALUES (0, 'x <- ' || k || chr(10) || 'print(x)'), (1, 'y <- ' || size)) t(chunk, code)")
def source_jupyter(spark: SparkSession, d: str) -> DataFrame:
    return S.jupyter(_parts(spark, d, IPYNB))


TOML = '[project]\nname = "part{k}"\nversion = "{size}.{brand}"\n\n[dependencies]\nalpha = ">= {size}"\nbeta = "*"\n'


@query(f"WITH {_P} SELECT path, key, value FROM p, LATERAL (VALUES ('project.name', 'part' || k), ('project.version', size || '.' || brand), ('dependencies.alpha', '>= ' || size), ('dependencies.beta', '*')) t(key, value)")
def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of a manifest."""
    return S.toml(_parts(spark, d, TOML))


@query(f"WITH {_P} SELECT path, 'part' || k AS name, size || '.' || brand AS version FROM p")
def source_manifest_meta(spark: SparkSession, d: str) -> DataFrame:
    """A project's name and version from its manifest."""
    return S.manifest_meta(S.toml(_parts(spark, d, TOML)))


@query(f"WITH {_P} SELECT path, package, version FROM p, LATERAL (VALUES ('alpha', '>= ' || size), ('beta', '*')) t(package, version)")
def source_manifest_versions(spark: SparkSession, d: str) -> DataFrame:
    return S.toml_packages(S.toml(_parts(spark, d, TOML)))


RENV = json.dumps({"R": {"Version": "4.{size}"}, "Packages": {"alpha": {"Package": "alpha", "Version": "{size}.1", "Source": "Repository"}, "part{k}": {"Package": "part{k}", "Version": "0.{brand}", "Source": "GitHub"}}})


@query(f"WITH {_P} SELECT path, package, version, source FROM p, LATERAL (VALUES ('alpha', size || '.1', 'Repository'), ('part' || k, '0.' || brand, 'GitHub')) t(package, version, source)")
def source_renv(spark: SparkSession, d: str) -> DataFrame:
    return S.renv(_parts(spark, d, RENV))


PACKRAT = "PackratFormat: 1.4\nRVersion: 4.{size}\n\nPackage: alpha\nSource: CRAN\nVersion: {size}.1\n\nPackage: part{k}\nSource: github\nVersion: 0.{brand}\n"


@query(f"WITH {_P} SELECT path, package, version, source FROM p, LATERAL (VALUES ('alpha', size || '.1', 'CRAN'), ('part' || k, '0.' || brand, 'github')) t(package, version, source)")
def source_packrat(spark: SparkSession, d: str) -> DataFrame:
    return S.packrat(_parts(spark, d, PACKRAT))


LOCK = 'version = 1\n\n[[packages]]\nname = "alpha"\nversion = "{size}.1"\n\n[[packages]]\nname = "part{k}"\nversion = "0.{brand}"\n'


@query(f"WITH {_P} SELECT path, package, version FROM p, LATERAL (VALUES ('alpha', size || '.1'), ('part' || k, '0.' || brand)) t(package, version)")
def source_rv_lock(spark: SparkSession, d: str) -> DataFrame:
    """Lock files that list packages as arrays of tables."""
    return S.toml_packages(S.toml(_parts(spark, d, LOCK)))


SESSION = "R version 4.{size}.1 (2024-01-01)\nattached base packages:\n[1] stats graphics\nother attached packages:\n[1] alpha_{size}.{brand} part{k}_0.{brand}\n"


@query(f"WITH {_P} SELECT path, package, version FROM p, LATERAL (VALUES ('R', '4.' || size || '.1'), ('alpha', size || '.' || brand), ('part' || k, '0.' || brand)) t(package, version)")
def source_session_info(spark: SparkSession, d: str) -> DataFrame:
    return S.session_info(_parts(spark, d, SESSION))


@query(
    f"""WITH {_P} SELECT path || name AS path, role FROM p, (VALUES ('/R/a.R', 'source'), ('/tests/testthat/test-a.R', 'test'), ('/vignettes/v.Rmd', 'vignette'), ('/inst/x.txt', 'install'),
    ('/DESCRIPTION', 'description'), ('/NAMESPACE', 'namespace'), ('/NEWS.md', 'news'), ('/LICENSE', 'license'), ('/renv.lock', 'lock'), ('/rproject.toml', 'manifest'), ('/uvr.toml', 'manifest'),
    ('/.Rprofile', 'profile'), ('/data/d.rda', 'data'), ('/notes.txt', 'other'), ('/n.ipynb', 'source')) t(name, role)"""
)
def source_roles(spark: SparkSession, d: str) -> DataFrame:
    """The roles of project files, by their paths."""
    names = ["/R/a.R", "/tests/testthat/test-a.R", "/vignettes/v.Rmd", "/inst/x.txt", "/DESCRIPTION", "/NAMESPACE", "/NEWS.md", "/LICENSE", "/renv.lock", "/rproject.toml", "/uvr.toml", "/.Rprofile", "/data/d.rda", "/notes.txt", "/n.ipynb"]
    paths = table(spark, d, "part").select(F.explode(F.transform(F.lit(names), lambda n: F.concat(F.lit("p"), F.col("p_partkey").cast("string"), n))).alias("path"))
    return paths.select("path", S.role(F.col("path")).alias("role"))


@query(
    f"""WITH {_P} SELECT path || name AS path FROM p, (VALUES ('/R/a.R'), ('/keep/k.log')) t(name) UNION ALL SELECT path || '/R/b' || size || '.R' FROM p WHERE size % 2 = 1"""
)
def source_ignore_files(spark: SparkSession, d: str) -> DataFrame:
    """What ignore files leave: folders, patterns, and what a later line takes back; and a build's own patterns."""
    k = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    names = F.array(*[F.concat(k, F.lit(n)) for n in ("/R/a.R", "/tmp/t.R", "/x.log", "/keep/k.log", "/old/o.R")], F.concat(k, F.lit("/R/b"), "p_size", F.lit(".R")))
    paths = table(spark, d, "part").select(F.explode(names).alias("path"))
    paths = S.not_ignored(paths, ["tmp/", "*.log", "!keep/*.log", *[f"b{i}.R" for i in range(0, 60, 2)]])
    return S.not_ignored(paths, ["/OLD/"], regex=True)


@query(
    f"""WITH {_P} SELECT path, file, CAST(place AS INTEGER) AS place FROM p, (VALUES ('.Rprofile', 1), ('R/z.R', 2), ('R/a.R', 3), ('R/b.R', 4), ('R/c.R', 5)) t(file, place)"""
)
def source_loading_order(spark: SparkSession, d: str) -> DataFrame:
    """Profiles, then what a description collates, then what others source, then the rest by name; in each project."""
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.explode(F.lit(["R/c.R", "R/b.R", "R/a.R", "R/z.R", ".Rprofile"])).alias("file"))
    order = rows.select("path").distinct().select("path", F.posexplode(F.lit(["z.R", "a.R"])).alias("at", "listed"))
    sourced = rows.select("path").distinct().select("path", F.lit("R/b.R").alias("file"))
    return S.project_order(rows, order, sourced).select("path", "file", "place")


@query("SELECT event_id, ts, user_id, value FROM events")
def source_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Delimited text, written and read back with its header."""
    from skein.storage import shared_dir

    path = f"{shared_dir(spark)}/skein-csv-{abs(hash(d))}"
    rows = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "value")
    rows.write.mode("overwrite").option("header", True).csv(path)
    got = S.read(spark, "read.csv", path)
    return got.select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long"), F.col("value").cast("double"))


@query(f"WITH {_P} SELECT path, name, t.type, n FROM (SELECT path FROM p) p, (VALUES ('k', 'integer', 1), ('sizes', 'double', 2)) t(name, type, n)")
def source_rdata(spark: SparkSession, d: str) -> DataFrame:
    """Serialised objects, written by hand in the format's text form, and read back."""
    from skein.sources import rdata

    # RDA text form: a pair list of two named vectors
    text = "RDA3\nA\n3\n262144\n197888\n5\nUTF-8\n1026\n1\n262153\n1\nk\n13\n1\n{k}\n1026\n1\n262153\n5\nsizes\n14\n2\n{size}\n{brand}.5\n254\n"
    files = _parts(spark, d, text).select("path", F.col("content").cast("binary").alias("content"))
    return rdata.objects(files).where("error is null").select("path", "name", "type", F.col("length").cast("int").alias("n"))


@query("SELECT 'x <- ' || n_nationkey AS content FROM nation")
def source_requests(spark: SparkSession, d: str) -> DataFrame:
    """Inputs that are the text itself."""
    inputs = [f"x <- {r.n_nationkey}" for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    return S.request(spark, *inputs).select("content")


@query(f"WITH {_P} SELECT 'lib/part' || k || '/DESCRIPTION' AS path, 'part' || k AS package, size || '.' || brand AS version FROM p")
def source_library(spark: SparkSession, d: str) -> DataFrame:
    """Installed packages, by their own descriptions."""
    files = _parts(spark, d, DESCRIPTION).select(F.concat(F.lit("lib/part"), F.substring("path", 2, 20), F.lit("/DESCRIPTION")).alias("path"), "content")
    return S.library(files.unionByName(files.select(F.concat("path", F.lit(".bak")).alias("path"), "content")))


@query(f"WITH {_P} SELECT path, size % 2 = 0 AS ok FROM p")
def source_verified(spark: SparkSession, d: str) -> DataFrame:
    """Files against the digests that are expected of them; half of these are another file's."""
    files = _parts(spark, d, NEWS)
    expected = files.join(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), "p_size"), "path")
    digest = F.sha2(F.concat("content", F.when(F.col("p_size") % 2 == 0, "").otherwise("x")).cast("binary"), 256)
    return S.verified(files, expected.select("path", digest.alias("sha256")))


@query(
    f"""WITH {_P} SELECT 'versions:description' AS origin, path, 'alpha' AS package, '>= ' || size AS version FROM p UNION ALL SELECT 'versions:description', path, 'beta', NULL FROM p
    UNION ALL SELECT 'versions:description', path, 'gamma', '< 2.' || brand FROM p UNION ALL SELECT 'versions:description', path, 'base' || brand, NULL FROM p
    UNION ALL SELECT 'versions:description', path, 'R', '>= 3.' || size FROM p UNION ALL SELECT 'versions:own', path, 'mine', size::VARCHAR FROM p"""
)
def source_plugins(spark: SparkSession, d: str) -> DataFrame:
    """Readers by key, one of them added from outside; their rows about packages in one table."""
    from skein import registry

    registry.register("versions:own", lambda files: files.select("path", F.lit("mine").alias("package"), F.regexp_extract("content", r"Version: (\d+)", 1).alias("version")))
    return registry.versions(_parts(spark, d, DESCRIPTION), ["versions:description", "versions:own"])


@query("SELECT event_id, event_type, value, props FROM events")
def source_bson(spark: SparkSession, d: str) -> DataFrame:
    """Rows as binary documents and back."""
    from skein.sources import bson

    rows = table(spark, d, "events").select("event_id", "event_type", "value", "props")
    return bson.decoded(bson.encoded(rows), "event_id long, event_type string, value double, props string")


@query("SELECT what, form, n FROM (VALUES ('ast', 'text', 4), ('ast', 'json', 4), ('cfg', 'mermaid', 1), ('dataflow', 'compact', 4)) t(what, form, n)")
def source_rendered(spark: SparkSession, d: str) -> DataFrame:
    """A small program in several output formats, by the number of lines, and by steps that need one another."""
    from skein import registry
    from skein.frontend.program import Program

    steps = registry.Steps().add("files", lambda: spark.createDataFrame([("f", "x <- 1")], "file_id string, content string")).add("program", Program, ["files"])
    p, out = steps.run("program")["program"], None
    for what, form in (("ast", "text"), ("ast", "json"), ("cfg", "mermaid"), ("dataflow", "compact")):
        one = registry.rendered(p, what, form).agg(F.count("*").cast("int").alias("n")).select(F.lit(what).alias("what"), F.lit(form).alias("form"), "n")
        out = one if out is None else out.union(one)
    return out
