"""Sources: project files as rows (path, content), and the formats inside them as tables.

Every reader is a projection of a whole-text scan, so Spark deals files to tasks and only the matching files are read;
formats with a grammar of their own are read by one Arrow-batched Python step per file.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names of source code and notebooks, and folders that discovery leaves out.
SOURCE = r"(?i)\.(r|rmd|qmd|rnw|ipynb)$"
IGNORED = r"(^|/)(\.git|\.Rproj\.user|renv|packrat|node_modules|__pycache__|\.venv)/"
#: Roles by path, the first that fits.
ROLES = {
    "test": r"(?i)(^|/)tests?/|(^|/)test[-_.][^/]*\.r$", "vignette": r"(?i)(^|/)vignettes/", "install": r"(^|/)inst/",
    "description": r"(^|/)DESCRIPTION$", "namespace": r"(^|/)NAMESPACE$", "news": r"(?i)(^|/)NEWS(\.md)?$", "license": r"(?i)(^|/)LICEN[CS]E(\.md|\.txt)?$",
    "lock": r"(^|/)(renv\.lock|packrat\.lock|rv\.lock|uvr\.lock)$", "manifest": r"(^|/)(rproject|uvr)\.toml$", "profile": r"(^|/)\.Rprofile$",
    "data": r"(?i)\.(rda|rdata|rds)$", "source": SOURCE,
}


def request(spark: SparkSession, *inputs: str) -> DataFrame:
    """path, content: `file://...` inputs name files, others are the text itself (path null)."""
    texts = [(None, x) for x in inputs if not x.startswith("file://")]
    paths = [x[7:] for x in inputs if x.startswith("file://")]
    out = spark.createDataFrame(texts, "path string, content string")
    return out.unionByName(contents(spark, *paths)) if paths else out


def contents(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """path, content of text files."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive)
    return reader.text(list(paths)).select(_plain(F.input_file_name()).alias("path"), F.col("value").alias("content"))


def _plain(uri: Column) -> Column:
    return F.regexp_replace(F.url_decode(uri), r"^[a-z]+:/*(?=/)", "")


def role(path: Column) -> Column:
    out = None
    for name, pattern in ROLES.items():
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out.otherwise("other")


def _glob_pattern(line: str) -> str:
    """An ignore file's glob as a regular expression over paths."""
    anchored, folder = line.startswith("/") or "/" in line.rstrip("/")[1:], line.endswith("/")
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", line.strip("/")))
    return ("(?:^|.*/)" if not anchored or not line.startswith("/") else "^") + body + ("/.*" if folder else "(?:/.*)?") + "$"


def ignore_pattern(lines: Sequence[str], regex: bool = False) -> str | None:
    """One regular expression for an ignore file's lines: globs, or regular expressions that any part may match. Lines that
    take something back need not_ignored()."""
    kept = [x.strip() for x in lines if x.strip() and not x.strip().startswith(("#", "!"))]
    return "|".join(f"(?i:{x})" if regex else _glob_pattern(x) for x in kept) or None


def not_ignored(paths: DataFrame, lines: Sequence[str], regex: bool = False, column: str = "path") -> DataFrame:
    """The rows whose path the lines of an ignore file leave: the last line that matches decides, `!` takes back."""
    verdict = F.lit(False)
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!") and not regex
        pattern = f"(?i:{line})" if regex else _glob_pattern(line[1:] if back else line)
        hit = F.col(column).rlike(pattern)
        verdict = F.when(hit, F.lit(not back)).otherwise(verdict)
    return paths.where(~verdict)


def discover(spark: SparkSession, root: str, ignore: Sequence[str] = (), build_ignore: Sequence[str] = (), every: bool = False) -> DataFrame:
    """path (below root), role and size of a project's files; only the listing is read, not the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_plain(F.col("path")).alias("path"), F.col("length").alias("size"))
    out = files.withColumn("path", F.regexp_replace("path", "^" + re.escape(root.removeprefix("file://").rstrip("/")) + "/", ""))
    out = out.where(~F.col("path").rlike(IGNORED))
    out = not_ignored(not_ignored(out, ignore), build_ignore, regex=True)
    out = out.withColumn("role", role(F.col("path")))
    return out if every else out.where("role <> 'other'")


# notebooks


def rmarkdown(files: DataFrame) -> DataFrame:
    """path, chunk, line (of the first code line), engine, options, code: fenced chunks of R Markdown and Quarto."""
    fence = r"(?m)^[ \t]*(`{3,}|~{3,})\{[ \t]*([A-Za-z0-9_]+)([^}\n]*)\}[^\n]*\n((?s:.*?))^[ \t]*\1[ \t]*$"
    found = files.select("path", "content", F.posexplode(F.regexp_extract_all("content", F.lit(fence), 0)).alias("chunk", "whole"))
    part = lambda i: F.regexp_extract("whole", fence, i)
    before = F.substring("content", F.lit(1), F.instr(F.col("content"), F.col("whole")) - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 2
    return found.select("path", "chunk", line.alias("line"), part(2).alias("engine"), F.regexp_replace(part(3), r"^[\s,]+|\s+$", "").alias("options"), part(4).alias("code"))


def chunk_options(chunks: DataFrame) -> DataFrame:
    """path, chunk, key, value of the options in a chunk's first lines, `#| key: value`."""
    lines = F.filter(F.split("code", "\n"), lambda x: x.startswith("#|"))
    rows = chunks.select("path", "chunk", F.explode(lines).alias("line"))
    return rows.select("path", "chunk", F.trim(F.regexp_extract("line", r"^#\|\s*([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^#\|[^:]+:(.*)$", 1)).alias("value"))


def restored(text: Column, code: Column, changed: Column) -> Column:
    """A notebook with one chunk's code replaced."""
    return F.replace(text, code, changed)


def sweave(files: DataFrame) -> DataFrame:
    """path, chunk, options, code: chunks from <<...>>= to @ or the next chunk."""
    chunk = r"(?m)^<<([^\n]*?)>>=[^\n]*\n((?s:.*?))(?=^@|^<<[^\n]*?>>=|\z)"
    found = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(chunk), 0)).alias("chunk", "whole"))
    return found.select("path", "chunk", F.regexp_extract("whole", chunk, 1).alias("options"), F.regexp_extract("whole", chunk, 2).alias("code"))



def jupyter(files: DataFrame) -> DataFrame:
    """path, chunk, code: code cells in order; a cell's source may be one text or an array of lines."""
    cells = F.from_json("content", "cells array<struct<cell_type: string, source: string>>")["cells"]
    rows = files.select("path", F.posexplode(F.filter(cells, lambda c: c["cell_type"] == "code")).alias("chunk", "cell"))
    lines = F.from_json("cell.source", "array<string>")
    return rows.select("path", "chunk", F.when(F.col("cell.source").startswith("["), F.concat_ws("", lines)).otherwise(F.col("cell.source")).alias("code"))


# package metadata


def dcf(files: DataFrame) -> DataFrame:
    """path, record, key, value: `Key: value` fields, continuation lines joined, blank lines between records."""
    records = files.select("path", F.posexplode(F.split("content", r"\n[ \t]*\n")).alias("record", "text"))
    folded = F.regexp_replace("text", r"\r?\n[ \t]+", " ")
    fields = records.select("path", "record", F.explode(F.split(folded, r"\r?\n")).alias("line")).where(F.col("line").rlike(r"^[A-Za-z][^:\s]*:"))
    return fields.select("path", "record", F.regexp_extract("line", r"^([^:]+):", 1).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("value"))


def meta(files: DataFrame) -> DataFrame:
    """path, name, version, title, license, authors (how many) of descriptions."""
    fields = dcf(files)
    of = lambda k, n: F.max(F.when(F.col("key") == k, F.col("value"))).alias(n)
    people = authors(fields).groupBy("path").agg(F.count("*").cast("int").alias("authors"))
    return fields.groupBy("path").agg(of("Package", "name"), of("Version", "version"), of("Title", "title"), of("License", "license")).join(people, "path", "left")


def manifest_meta(leaves: DataFrame) -> DataFrame:
    """path, name, version of manifests."""
    of = lambda n: F.max(F.when(F.col("key").rlike(rf"^(?:project\.|package\.)?{n}$"), F.col("value"))).alias(n)
    return leaves.groupBy("path").agg(of("name"), of("version"))


def namespace_imports(directives: DataFrame) -> DataFrame:
    """path, package, names: what namespace files import; no names stand for all."""
    whole = directives.where("directive = 'import'").select("path", F.explode("args").alias("package"), F.array().cast("array<string>").alias("names"))
    some = directives.where("directive = 'importFrom'").select("path", F.col("args")[0].alias("package"), F.slice("args", F.lit(2), F.size("args")).alias("names"))
    return whole.union(some)


def dependencies(fields: DataFrame) -> DataFrame:
    """path, type, package, constraint (null for any) from a description's fields."""
    kinds = ("Depends", "Imports", "Suggests", "Enhances", "LinkingTo")
    items = fields.where(F.col("key").isin(*kinds)).select("path", F.col("key").alias("type"), F.explode(F.split("value", r"\s*,\s*")).alias("item"))
    item = r"^\s*([A-Za-z][A-Za-z0-9.]*)\s*(?:\(([^)]*)\))?\s*$"
    rows = items.where(F.col("item").rlike(item))
    return rows.select("path", "type", F.regexp_extract("item", item, 1).alias("package"), F.nullif(F.trim(F.regexp_extract("item", item, 2)), F.lit("")).alias("constraint"))


def authors(fields: DataFrame) -> DataFrame:
    """path, name, email, roles from Authors@R fields: person(given, family, role =, email =)."""
    people = fields.where("key = 'Authors@R'").select("path", F.explode(F.regexp_extract_all("value", F.lit(r"person\(((?:[^()]|\([^()]*\))*)\)"), 1)).alias("p"))
    named = lambda k: F.regexp_extract("p", rf"\b{k}\s*=\s*[\"']([^\"']*)[\"']", 1)
    free = F.regexp_extract_all(F.regexp_replace("p", r"\b\w+\s*=\s*(c\([^()]*\)|[\"'][^\"']*[\"'])", ""), F.lit(r"[\"']([^\"']*)[\"']"), 1)
    name = F.concat_ws(" ", F.nullif(named("given"), F.lit("")), free, F.nullif(named("family"), F.lit("")))
    roles = F.regexp_extract_all(F.regexp_extract("p", r"\brole\s*=\s*(c\([^()]*\)|[\"'][^\"']*[\"'])", 1), F.lit(r"[\"']([^\"']*)[\"']"), 1)
    return people.select("path", name.alias("name"), F.nullif(named("email"), F.lit("")).alias("email"), roles.alias("roles"))


def licenses(fields: DataFrame) -> DataFrame:
    """path, license: alternatives and parts of a license field."""
    parts = fields.where("key = 'License'").select("path", F.explode(F.split("value", r"\s*[|+]\s*")).alias("license"))
    return parts.where("license <> ''")


def namespace(files: DataFrame) -> DataFrame:
    """path, directive, args of a namespace file's directives."""
    clean = F.regexp_replace("content", r"(?m)#.*$", "")
    call = r"(export|exportPattern|exportClasses|exportMethods|import|importFrom|importClassesFrom|importMethodsFrom|S3method|useDynLib)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)"
    calls = files.select("path", F.explode(F.regexp_extract_all(clean, F.lit(call), 0)).alias("call"))
    args = F.transform(F.split(F.regexp_extract("call", call, 2), r"\s*,\s*"), lambda x: F.regexp_replace(F.trim(x), r"^[\"'`]|[\"'`]$", ""))
    return calls.select("path", F.regexp_extract("call", call, 1).alias("directive"), F.filter(args, lambda x: x != "").alias("args"))


def news(files: DataFrame) -> DataFrame:
    """path, version, entry: bullets under version headings."""
    lines = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("i", "line"))
    version = F.regexp_extract("line", r"(?i)^(?:#+\s*|changes in\s+)?(?:version\s+|[A-Za-z][A-Za-z0-9.]*\s+)?v?(\d+(?:[.-]\d+)+)", 1)
    from pyspark.sql.window import Window

    w = Window.partitionBy("path").orderBy("i")
    rows = lines.withColumn("version", F.last(F.nullif(version, F.lit("")), ignorenulls=True).over(w))
    return rows.where(F.col("line").rlike(r"^\s*[*-]\s+") & F.col("version").isNotNull()).select("path", "version", F.regexp_replace("line", r"^\s*[*-]\s+", "").alias("entry"))


def session_info(files: DataFrame) -> DataFrame:
    """package, version of printed session information, and the language's own as package R."""
    pairs = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\b[A-Za-z][A-Za-z0-9.]*_\d+(?:[.-]\d+)+"), 0)).alias("p"))
    out = pairs.select("path", F.regexp_extract("p", r"^(.*)_", 1).alias("package"), F.regexp_extract("p", r"_([^_]*)$", 1).alias("version"))
    own = files.select("path", F.lit("R").alias("package"), F.regexp_extract("content", r"R version (\d+(?:\.\d+)+)", 1).alias("version")).where("version <> ''")
    return own.union(out).distinct()


def renv(files: DataFrame) -> DataFrame:
    """path, package, version, source of renv lock files."""
    packages = F.map_entries(F.from_json(F.get_json_object("content", "$.Packages"), "map<string, struct<Version: string, Source: string>>"))
    rows = files.select("path", F.explode(packages).alias("e"))
    return rows.select("path", F.col("e.key").alias("package"), F.col("e.value.Version").alias("version"), F.col("e.value.Source").alias("source"))


def packrat(files: DataFrame) -> DataFrame:
    """path, package, version, source of packrat lock files."""
    rows = dcf(files).groupBy("path", "record").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for k, n in (("Package", "package"), ("Version", "version"), ("Source", "source"))])
    return rows.where("package is not null").drop("record")


def _toml_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, text in zip(batch.path, batch.content, strict=True):
            try:
                data = tomllib.loads(text or "")
            except tomllib.TOMLDecodeError:
                continue
            todo = [("", data)]
            while todo:
                at, x = todo.pop()
                if isinstance(x, dict):
                    todo += [(f"{at}.{k}" if at else k, v) for k, v in x.items()]
                elif isinstance(x, list):
                    todo += [(f"{at}[{i}]", v) for i, v in enumerate(x)]
                else:
                    out.append((path, at, x if isinstance(x, str) else json.dumps(x, default=str)))
        yield pd.DataFrame(out, columns=["path", "key", "value"])


def toml(files: DataFrame) -> DataFrame:
    """path, key, value of every leaf: `a.b[0].c` names a place. Files that are not TOML have no rows."""
    return files.select("path", "content").mapInPandas(_toml_rows, "path string, key string, value string")


def library(files: DataFrame) -> DataFrame:
    """path, package, version of an installed library: each package's own description."""
    of = lambda k, n: F.max(F.when(F.col("key") == k, F.col("value"))).alias(n)
    return dcf(files.where(F.col("path").rlike(r"(^|/)DESCRIPTION$"))).groupBy("path").agg(of("Package", "package"), of("Version", "version"))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path, ok: whether files (path, content) have the SHA-256 digests that are expected (path, sha256); files that are
    not there are not ok."""
    got = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("_sha"))
    return expected.join(got, "path", "left").select("path", F.coalesce(F.lower("sha256") == F.col("_sha"), F.lit(False)).alias("ok"))


def toml_packages(leaves: DataFrame) -> DataFrame:
    """path, package, version of manifests and lock files: packages and dependencies, as tables or arrays of them."""
    place = r"^(?:.*\.)?(packages|package|dependencies)(?:\[(\d+)\])?(?:\.([^.\[]+))?$"
    rows = leaves.where(F.col("key").rlike(place)).select("path", F.regexp_extract("key", r"^(.*?)(?:\.[^.\[]+)?$", 1).alias("at"), F.regexp_extract("key", r"([^.\[]+)(?:\[\d+\])?$", 1).alias("field"), "key", "value")
    array = rows.where(F.col("at").rlike(r"\]$")).groupBy("path", "at").agg(F.max(F.when(F.col("field") == "name", F.col("value"))).alias("package"), F.max(F.when(F.col("field") == "version", F.col("value"))).alias("version"))
    plain = rows.where(F.col("key").rlike(r"\[\d+\]$")).select("path", F.regexp_extract("value", r"^([A-Za-z][A-Za-z0-9.]*)", 1).alias("package"), F.nullif(F.regexp_extract("value", r"^[A-Za-z][A-Za-z0-9.]*\s*\(?([^()]*)\)?$", 1), F.lit("")).alias("version"))
    table = rows.where(~F.col("key").rlike(r"\[\d+\]")).select("path", F.col("field").alias("package"), F.col("value").alias("version"))
    return array.select("path", "package", "version").where("package is not null").union(plain.where("package <> ''")).union(table)


# delimited text


def delimited(spark: SparkSession, *paths: str, sep: str = ",", header: bool = True, comment: str | None = None, decimal: str = ".") -> DataFrame:
    """Delimited files with all columns as text but for decimal commas; casting is the caller's, so no extra pass guesses types."""
    reader = spark.read.option("header", header).option("sep", sep)
    df = (reader.option("comment", comment) if comment else reader).csv(list(paths))
    if decimal == ",":
        df = df.select(*[F.regexp_replace(c, r"^(-?\d+),(\d+)$", "$1.$2").alias(c) for c in df.columns])
    return df


#: Readers of the analysed language by name.
READERS = {
    "read.csv": {"sep": ","}, "read.csv2": {"sep": ";", "decimal": ","}, "read.delim": {"sep": "\t"}, "read.delim2": {"sep": "\t", "decimal": ","},
    "read.table": {"sep": " ", "header": False, "comment": "#"}, "read_csv": {"sep": ","}, "read_csv2": {"sep": ";", "decimal": ","}, "read_tsv": {"sep": "\t"},
}


def read(spark: SparkSession, function: str, *paths: str) -> DataFrame:
    return delimited(spark, *paths, **READERS[function])


def read_table(spark: SparkSession, *paths: str, names: Sequence[str]) -> DataFrame:
    """Columns between runs of white space."""
    cells = F.split(F.trim("value"), r"\s+")
    return spark.read.text(list(paths)).where(F.trim("value") != "").select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_fixed(spark: SparkSession, *paths: str, widths: dict[str, int]) -> DataFrame:
    """Columns of fixed widths, trimmed."""
    at, out = 1, []
    for name, width in widths.items():
        out.append(F.trim(F.substring("value", at, width)).alias(name))
        at += width
    return spark.read.text(list(paths)).select(*out)


# order


def loading_order(files: DataFrame, collate: Sequence[str] = (), first: Sequence[str] = (".Rprofile",)) -> DataFrame:
    """files with `place`: profiles, then the listed files in order, then the others by path."""
    from pyspark.sql.window import Window

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    listed = F.array_position(F.lit(list(collate)) if collate else F.array().cast("array<string>"), name)
    group = F.when(name.isin(*first), 0).when(listed > 0, 1).otherwise(2)
    return files.withColumn("place", F.row_number().over(Window.orderBy(group, listed, "path")))


def project_order(files: DataFrame, collate: DataFrame, sourced: DataFrame, first: Sequence[str] = (".Rprofile",)) -> DataFrame:
    """files (path, file) of projects with `place` in each: profiles, then what the project's description lists (path, at,
    listed), then files that others source (path, file), then the rest by name."""
    from pyspark.sql.window import Window

    name = F.regexp_extract("file", r"([^/]*)$", 1)
    out = files.withColumn("_name", name).join(collate.select("path", F.col("listed").alias("_name"), F.col("at").alias("_at")), ["path", "_name"], "left")
    out = out.join(sourced.select("path", "file", F.lit(True).alias("_sourced")).distinct(), ["path", "file"], "left")
    group = F.when(F.col("_name").isin(*first), 0).when(F.col("_at").isNotNull(), 1).when(F.col("_sourced"), 2).otherwise(3)
    order = Window.partitionBy("path").orderBy(group, "_at", "file")
    return out.withColumn("place", F.row_number().over(order)).select(*files.columns, "place")
