"""Shapes of programs' data frames: a script for each nation and each operation, whose sizes follow the nation's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.frontend.shapes import inferred, invalid
from skein.plans.analysis import filled
from skein.plans.registry import query
from skein.session import table

BASE = "x <- data.frame(a = 1:{k}, b = 2)\nz <- data.frame(a = 1:3, c = 4:6)\n"
#: Scripts that give y, by operation: must, may (None: any), columns and rows, k being the nation's number plus 3; None has no bound.
CASES: dict[str, tuple[str, str, str | None, tuple, tuple]] = {
    "data.frame": ("y <- data.frame(p = 1:{k}, q = 'u')", "p,q", "p,q", (2, 2), ("k", "k")),
    "as.data.frame": ("y <- as.data.frame(x)", "a,b", "a,b", (2, 2), ("k", "k")),
    "tibble": ("y <- tibble(p = 1:{k})", "p", "p", (1, 1), ("k", "k")),
    "read.csv": ("y <- read.csv('f.csv')", "", None, (0, None), (0, None)),
    "read.delim2": ("y <- read.delim2('f')", "", None, (0, None), (0, None)),
    "read_table": ("y <- read_table('f')", "", None, (0, None), (0, None)),
    "read_delim": ("y <- read_delim('f')", "", None, (0, None), (0, None)),
    "accessCols": ("y <- x['a']", "a", "a", (1, 1), ("k", "k")),
    "accessRows": ("y <- x[1:2, ]", "a,b", "a,b", (2, 2), (2, 2)),
    "beyond the rows": ("y <- x[c(50, 60, 70), ]", "a,b", "a,b", (2, 2), (3, 3)),
    "all rows": ("y <- x[TRUE, ]", "a,b", "a,b", (2, 2), ("k", "k")),
    "no rows": ("y <- x[0, ]", "a,b", "a,b", (2, 2), (0, 0)),
    "rows by condition": ("y <- x[x$a > 2, ]", "a,b", "a,b", (2, 2), (0, "k")),
    "rows by anything": ("y <- x[i, ]", "a,b", "a,b", (2, 2), (0, None)),
    "rows but one": ("y <- x[-1, ]", "a,b", "a,b", (2, 2), ("k - 1", "k")),
    "assignCols": ("y <- x\ny$c <- 1", "a,b,c", "a,b,c", (2, 3), ("k", "k")),
    "part of a column": ("y <- x\ny$c[2] <- 1", "a,b,c", "a,b,c", (2, 3), ("k", "k")),
    "assignRows": ("y <- x\ny[40, ] <- 1", "a,b", "a,b", (2, 2), (40, 40)),
    "a cell": ("y <- x\ny[40, 'a'] <- 1", "a,b", "a,b", (2, 3), (40, 40)),
    "removeCols": ("y <- x\ny$a <- NULL", "b", "b", (1, 2), ("k", "k")),
    "setColNames": ("y <- x\nnames(y) <- c('p', 'q')", "p,q", "p,q", (2, 2), ("k", "k")),
    "cbind": ("y <- cbind(x, d = 3)", "a,b,d", "a,b,d", (3, 3), ("k", "k")),
    "rbind": ("y <- rbind(x, x)", "a,b", "a,b", (2, 2), ("2 * k", "2 * k")),
    "head": ("y <- head(x, 2)", "a,b", "a,b", (2, 2), (2, 2)),
    "head of all but": ("y <- head(x, -2)", "a,b", "a,b", (2, 2), ("k - 2", "k - 2")),
    "tail": ("y <- tail(x, 1)", "a,b", "a,b", (2, 2), (1, 1)),
    "subset": ("y <- subset(x, a > 1, select = c(a))", "a", "a", (1, 1), (0, "k")),
    "filter": ("y <- filter(x, a > 1)", "a,b", "a,b", (2, 2), (0, "k")),
    "filter false": ("y <- filter(x, FALSE)", "a,b", "a,b", (2, 2), (0, 0)),
    "select": ("y <- select(x, b)", "b", "b", (1, 1), ("k", "k")),
    "select renamed": ("y <- select(x, new = a)", "", None, (1, 1), ("k", "k")),
    "select but": ("y <- select(x, -c(a))", "b", "b", (1, 2), ("k", "k")),
    "mutate": ("y <- mutate(x, c = a)", "a,b,c", "a,b,c", (2, 3), ("k", "k")),
    "mutate away": ("y <- mutate(x, a = NULL)", "b", "b", (1, 2), ("k", "k")),
    "transform": ("y <- transform(x, c = a)", "a,b,c", "a,b,c", (2, 3), ("k", "k")),
    "transmute": ("y <- transmute(x, c = a)", "c", "c", (1, 1), ("k", "k")),
    "rename": ("y <- rename(x, c = a)", "b,c", "b,c", (2, 2), ("k", "k")),
    "group_by": ("y <- group_by(x, a)", "a,b", "a,b", (2, 2), ("k", "k")),
    "summarise": ("y <- summarise(x, m = 1)", "m", "a,b,m", (1, 3), (1, "k")),
    "inner_join": ("y <- inner_join(x, z, by = 'a')", "a,b,c", "a,b,c", (3, 3), (0, "k")),
    "left_join": ("y <- left_join(x, z, by = 'a')", "a,b,c", "a,b,c", (3, 3), ("k", "k")),
    "right_join": ("y <- right_join(x, z, by = 'a')", "a,b,c", "a,b,c", (3, 3), (3, "k")),
    "full_join": ("y <- full_join(x, z, by = 'a')", "a,b,c", "a,b,c", (3, 3), ("k", "k + 3")),
    "merge": ("y <- merge(x, z, by = 'a')", "a,b,c", "a,b,c", (3, 3), (0, "k")),
    "arrange": ("y <- arrange(x, a)", "a,b", "a,b", (2, 2), ("k", "k")),
    "relocate": ("y <- relocate(x, b)", "a,b", "a,b", (2, 2), ("k", "k")),
    "unique": ("y <- unique(x)", "a,b", "a,b", (2, 2), (1, "k")),
    "na.omit": ("y <- na.omit(x)", "a,b", "a,b", (2, 2), (0, "k")),
    "semi_join": ("y <- semi_join(x, z)", "a,b", "a,b", (2, 2), (0, "k")),
    "bind_cols": ("y <- bind_cols(x, data.frame(d = 1:{k}))", "a,b,d", "a,b,d", (3, 3), ("k", "k")),
    "add_row": ("y <- add_row(x, a = 1)", "a,b", None, (2, None), ("k + 1", None)),
    "aggregate": ("y <- aggregate(x, by = list(1), FUN = mean)", "", None, (0, None), (0, None)),
    "unknown": ("y <- mystery(x)", "", None, (0, None), (0, None)),
    "branch": ("if (u) y <- x else y <- head(x, 1)", "a,b", "a,b", (2, 2), (1, "k")),
    "loop": ("y <- x\nfor (i in 1:3) y <- rbind(y, head(x, 1))", "a,b", "a,b", (2, 2), ("k", None)),
    "piped": ("y <- x |> filter(a > 1) |> mutate(d = a) |> select(d)", "d", "d", (1, 1), (0, "k")),
}


def _files(spark: SparkSession, d: str, codes: dict[str, str]) -> DataFrame:
    """A script for each nation and operation; {k} is the nation's number plus 3."""
    k = table(spark, d, "nation").select((F.col("n_nationkey") + 3).alias("k"))
    rows = k.withColumn("x", F.explode(F.lit([f"{name}\0{BASE}{code}\n" for name, code in codes.items()])))
    return rows.select(F.concat(F.substring_index("x", "\0", 1), F.lit("-"), "k").alias("file_id"), filled("{x}", x=F.replace(F.substring_index("x", "\0", -1), F.lit("{k}"), F.col("k").cast("string"))).alias("content"))


def _sql() -> str:
    rows = []
    bound = lambda x: "NULL" if x is None else f"'{x}'"
    for name, (_, must, may, cols, lines) in CASES.items():
        rows.append(f"('{name}', '{must}', {bound(may)}, {', '.join(bound(x) for x in (*cols, *lines))})")
    value = lambda c: f"CAST(CASE {c} WHEN 'k' THEN k WHEN 'k - 1' THEN k - 1 WHEN 'k - 2' THEN k - 2 WHEN '2 * k' THEN 2 * k WHEN 'k + 3' THEN k + 3 WHEN 'k + 1' THEN k + 1 ELSE TRY_CAST({c} AS INTEGER) END AS DOUBLE)"
    picked = ", ".join(f"{value(c)} AS {c}" for c in ("cols_lo", "cols_hi", "rows_lo", "rows_hi"))
    return f"SELECT op, k, must, may, {picked} FROM (SELECT n_nationkey + 3 AS k FROM nation), (VALUES {', '.join(rows)}) t(op, must, may, cols_lo, cols_hi, rows_lo, rows_hi)"


def _case() -> list:
    return [F.regexp_replace("file_id", r"-\d+$", "").alias("op"), F.regexp_extract("file_id", r"-(\d+)$", 1).cast("int").alias("k")]


@query(_sql())
def frame_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Names, columns and rows of a frame after each operation."""
    got = inferred(_files(spark, d, {name: case[0] for name, case in CASES.items()})).where("id is null and name = 'y'")
    names = lambda c: F.array_join(F.array_sort(c), ",")
    return got.select(*_case(), names("must").alias("must"), names("may").alias("may"), "cols_lo", "cols_hi", "rows_lo", "rows_hi")


@query(
    """SELECT 'column' AS op, n_nationkey + 3 AS k, 'zz' AS "column", NULL::BIGINT AS number, false AS is_row FROM nation
    UNION ALL SELECT 'row', n_nationkey + 3, NULL, 20, true FROM nation WHERE n_nationkey + 3 < 20 UNION ALL SELECT 'place', n_nationkey + 3, NULL, 7, false FROM nation"""
)
def frame_invalid_accesses(spark: SparkSession, d: str) -> DataFrame:
    """Accesses that a frame's shape rules out."""
    codes = {"column": "x[['zz']]", "row": "x[20, ]", "place": "x[[7]]", "fine": "x$a", "unknown": "x[[v]]"}
    return invalid(_files(spark, d, codes)).select(*_case(), "column", "number", "is_row")
