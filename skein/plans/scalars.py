"""Scalar folding over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import scalar as S
from skein.functions import versions as V
from skein.plans.registry import query
from skein.session import table

_R = lambda x: F.round(x, 6)


@query(
    """SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS add, round(l_quantity - l_tax, 6) AS sub, round(l_quantity * l_discount, 6) AS mul,
    CASE WHEN l_discount <> 0 THEN round(l_quantity / l_discount, 6) END AS div, round(l_tax ** 2, 6) AS pow,
    CAST((0 - l_linenumber) - 3 * floor((0 - l_linenumber) / 3) AS DOUBLE) AS modulo, CAST(floor((0 - l_linenumber) / 3) AS DOUBLE) AS whole FROM lineitem"""
)
def scalar_math_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    q, t, c, n = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_linenumber")
    b = S.BINARY
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", _R(b["+"](q, t)).alias("add"), _R(b["-"](q, t)).alias("sub"), _R(b["*"](q, c)).alias("mul"), _R(b["/"](q, c)).alias("div"),
        _R(b["^"](t, F.lit(2))).alias("pow"), b["%%"](-n, F.lit(3)).alias("modulo"), b["%/%"](-n, F.lit(3)).alias("whole"),
    )


@query(
    """SELECT p_partkey, round_even(p_retailprice, 0) AS rounded, round(sqrt(p_size), 6) AS root, floor(p_retailprice) AS low, ceil(p_retailprice) AS high,
    trunc(0 - p_retailprice) AS cut, CAST(sign(p_size - 25) AS DOUBLE) AS sgn, abs(CAST(p_size - 25 AS DOUBLE)) AS magnitude FROM part"""
)
def scalar_math_rounding(spark: SparkSession, d: str) -> DataFrame:
    x, s, u = F.col("p_retailprice"), F.col("p_size"), S.UNARY
    return table(spark, d, "part").select(
        "p_partkey", u["round"](x).alias("rounded"), _R(u["sqrt"](s)).alias("root"), u["floor"](x).alias("low"), u["ceiling"](x).alias("high"),
        u["trunc"](-x).alias("cut"), u["sign"](s - 25).alias("sgn"), u["abs"](s - 25).alias("magnitude"),
    )


@query(
    """SELECT p_partkey, round(exp(p_size / 10), 6) AS e, round(exp(p_size / 10) - 1, 6) AS e1, round(ln(p_size), 6) AS l, round(log2(p_size), 6) AS l2,
    round(log10(p_size), 6) AS l10, round(ln(1 + p_size), 6) AS l1, round(ln(p_size) / ln(3), 6) AS l3 FROM part"""
)
def scalar_math_exponential(spark: SparkSession, d: str) -> DataFrame:
    s, u = F.col("p_size"), S.UNARY
    return table(spark, d, "part").select(
        "p_partkey", _R(u["exp"](s / 10)).alias("e"), _R(u["expm1"](s / 10)).alias("e1"), _R(u["log"](s)).alias("l"), _R(u["log2"](s)).alias("l2"),
        _R(u["log10"](s)).alias("l10"), _R(u["log1p"](s)).alias("l1"), _R(S.log(s, 3)).alias("l3"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(tan(l_tax), 6) AS t, round(asin(l_tax), 6) AS a_s,
    round(acos(l_tax), 6) AS a_c, round(atan(l_quantity), 6) AS a_t, round(atan2(l_quantity, l_tax), 6) AS a_2, round(sinh(l_tax), 6) AS sh, round(cosh(l_tax), 6) AS ch,
    round(tanh(l_tax), 6) AS th, round(asinh(l_quantity), 6) AS a_sh, round(acosh(l_quantity), 6) AS a_ch, round(atanh(l_tax), 6) AS a_th,
    CASE WHEN l_quantity <= 1 THEN round(asin(least(l_quantity, 1)), 6) END AS outside FROM lineitem"""
)
def scalar_math_trigonometry(spark: SparkSession, d: str) -> DataFrame:
    q, t, u = F.col("l_quantity"), F.col("l_tax"), S.UNARY
    names = {"s": ("sin", q), "c": ("cos", q), "t": ("tan", t), "a_s": ("asin", t), "a_c": ("acos", t), "a_t": ("atan", q), "sh": ("sinh", t), "ch": ("cosh", t),
             "th": ("tanh", t), "a_sh": ("asinh", q), "a_ch": ("acosh", q), "a_th": ("atanh", t), "outside": ("asin", q)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _R(S.BINARY["atan2"](q, t)).alias("a_2"), *[_R(u[f](x)).alias(n) for n, (f, x) in names.items()])


@query("SELECT p_partkey, CASE WHEN p_retailprice >= 1000 THEN round_even(p_retailprice / 10, 0) * 10 ELSE round_even(p_retailprice, 0) END AS three FROM part")
def scalar_math_signif(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.signif(F.col("p_retailprice"), 3).alias("three"))


@query(
    """SELECT p_partkey, p_size & 12 AS a, p_size | 12 AS o, xor(p_size, 12) AS x, ~p_size AS n,
    CAST((CAST(p_size AS BIGINT) << 3) AS INTEGER) AS l, CAST(((4294967296 - p_size) >> 1) AS INTEGER) AS r FROM part"""
)
def scalar_bits(spark: SparkSession, d: str) -> DataFrame:
    s, k, b = F.col("p_size"), F.lit(12), S.BINARY
    return table(spark, d, "part").select(
        "p_partkey", b["bitwAnd"](s, k).alias("a"), b["bitwOr"](s, k).alias("o"), b["bitwXor"](s, k).alias("x"), S.UNARY["bitwNot"](s).alias("n"),
        b["bitwShiftL"](s, F.lit(3)).alias("l"), b["bitwShiftR"](-s, F.lit(1)).alias("r"),
    )


@query(
    """SELECT p_partkey, p_name || ' ' || p_brand AS pasted, p_name || p_size AS glued, p_brand || '/' || p_type AS path, upper(p_name) AS up, lower(p_brand) AS low,
    length(p_name) AS n, trim('  ' || p_name || ' ') AS trimmed FROM part"""
)
def scalar_string_paste(spark: SparkSession, d: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select(
        "p_partkey", S.paste(name, brand).alias("pasted"), S.paste0(name, F.col("p_size")).alias("glued"), S.file_path(brand, F.col("p_type")).alias("path"),
        S.TEXT["toupper"](name).alias("up"), S.TEXT["tolower"](brand).alias("low"), S.TEXT["nchar"](name).alias("n"),
        S.TEXT["trimws"](F.concat(F.lit(" \t"), name, F.lit("\n"))).alias("trimmed"),
    )


@query(
    """SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base, regexp_replace(regexp_replace(url, '/+$', ''), '/*[^/]*$', '') AS dir,
    regexp_matches(url, '^(https?|ftp|ftps|file)://\\S+$') AS url, regexp_matches(url, '^/') AS absolute FROM pages"""
)
def scalar_string_paths(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.basename(u).alias("base"), S.dirname(u).alias("dir"), S.is_url(u).alias("url"), S.is_absolute_path(u).alias("absolute"))


@query(
    """SELECT o_orderkey, o_totalprice > 100000 AS gt, o_orderstatus = 'F' AS eq, o_totalprice > 100000 AND o_orderstatus = 'F' AS both,
    o_totalprice > 100000 OR o_orderstatus = 'F' AS either, (o_totalprice > 100000) <> (o_orderstatus = 'F') AS one, NOT (o_orderstatus = 'F') AS neq FROM orders"""
)
def scalar_cmp_logic(spark: SparkSession, d: str) -> DataFrame:
    b = S.BINARY
    gt, eq = b[">"](F.col("o_totalprice"), F.lit(100000)), b["=="](F.col("o_orderstatus"), F.lit("F"))
    return table(spark, d, "orders").select(
        "o_orderkey", gt.alias("gt"), eq.alias("eq"), b["&&"](gt, eq).alias("both"), b["||"](gt, eq).alias("either"), b["xor"](gt, eq).alias("one"), S.UNARY["!"](eq).alias("neq")
    )


@query(
    """SELECT p_partkey, CAST(list_sum(range(1, p_size + 1)) AS BIGINT) AS up, CAST(p_size AS BIGINT) AS n, CAST(2 * list_sum(range(1, p_size + 1)) AS BIGINT) AS doubled,
    p_size + 1 AS combined FROM part"""
)
def seq_vector(spark: SparkSession, d: str) -> DataFrame:
    seq = S.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    rows = table(spark, d, "part").select("p_partkey", "p_size", seq.alias("v"))
    return rows.select(
        "p_partkey", total(F.col("v")).alias("up"), F.size("v").cast("long").alias("n"), total(S.vector(S.BINARY["+"], F.col("v"), F.col("v"))).alias("doubled"),
        F.size(S.combine(F.col("v"), F.array(F.lit(0).cast("long")))).alias("combined"),
    )


@query(
    """WITH t AS (SELECT user_id, CASE event_type WHEN 'error' THEN false WHEN 'signup' THEN NULL ELSE true END AS x FROM events)
    SELECT user_id, CASE WHEN bool_or(x = false) THEN false WHEN count(*) FILTER (x IS NULL) = 0 THEN true END AS every,
    CASE WHEN bool_or(x = true) THEN true WHEN count(*) FILTER (x IS NULL) = 0 THEN false END AS some FROM t GROUP BY 1"""
)
def three_valued_logic(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("event_type") == "error", F.lit(False)).when(F.col("event_type") != "signup", F.lit(True))
    rows = table(spark, d, "events").select("user_id", x.alias("x"))
    return rows.groupBy("user_id").agg(S.all_true(F.col("x")).alias("every"), S.any_true(F.col("x")).alias("some"))


@query(
    """WITH v AS (SELECT p_partkey, p_size // 10 AS a, p_size % 10 AS b FROM part)
    SELECT p_partkey, a || '.' || b AS version, a * 10 + b >= 12 AND a * 10 + b < 30 AS met, a * 10 + b <> 21 AS other FROM v"""
)
def version_satisfies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.concat((F.col("p_size") / 10).cast("int"), F.lit("."), F.col("p_size") % 10).alias("version"))
    return rows.select("p_partkey", "version", V.satisfies(F.col("version"), F.lit(">= 1.2, < 3.0")).alias("met"), V.satisfies(F.col("version"), F.lit("!= 2.1")).alias("other"))


@query("SELECT p_brand, (max(p_size) // 10) || '.' || (max(p_size) % 10) AS version FROM part GROUP BY 1")
def version_highest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.concat((F.col("p_size") / 10).cast("int"), F.lit("."), F.col("p_size") % 10).alias("version"))
    return rows.groupBy("p_brand").agg(V.highest(F.col("version")).alias("version"))


@query(
    """SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z]+ [a-z]*ing$') AS ring, regexp_matches(p_brand, '[#]') AS marked, regexp_matches(p_type, '^[A-Z]+$') AS loud FROM part"""
)
def scalar_posix_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns with POSIX classes."""
    from skein.functions import text as T

    like = lambda c, p: F.regexp_like(F.col(c), T.pattern(F.lit(p)))
    return table(spark, d, "part").select("p_partkey", like("p_name", "^[[:alpha:]]+[[:blank:]][[:lower:]]*ing$").alias("ring"), like("p_brand", "[[:punct:]]").alias("marked"), like("p_type", "^[[:upper:]]+$").alias("loud"))


@query(
    """SELECT p_partkey, -(p_size % 3) * 150 - length(p_type) * 12 + least(log10(p_size + 10), 8) * 4 + CASE WHEN p_type = 'SMALL' THEN 3000 WHEN lower(p_type) = 'small' THEN 900 ELSE 0 END
      + CASE WHEN p_size % 2 = 0 THEN 40 ELSE 0 END + CASE WHEN p_size % 4 = 0 THEN 20 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 500 ELSE 0 END - CASE WHEN p_size % 7 = 0 THEN 30 ELSE 0 END
      - CASE WHEN p_size % 11 = 0 THEN 20 ELSE 0 END - CASE WHEN p_type <> 'SMALL' THEN 30 ELSE 0 END AS points FROM part"""
)
def scalar_name_rank(spark: SparkSession, d: str) -> DataFrame:
    """How well part types answer SMALL, as names that were typed."""
    from skein.functions import text as T

    s = F.col("p_size")
    base = F.when(s % 2 == 0, s % 4 == 0)
    points = T.name_rank(F.col("p_type"), F.lit("SMALL"), s % 3, s, base, s % 5 == 0, s % 7 == 0, s % 11 == 0)
    return table(spark, d, "part").select("p_partkey", points.alias("points"))


@query(
    """SELECT o_orderkey, year(o_orderdate) <= 1996 AS upto, o_orderdate::DATE >= DATE '1995-03-01' AS since, o_orderdate::DATE < DATE '1997-01-01' AS before,
    o_orderdate::DATE > DATE '1995-03-31' AS after, o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-31' AS month FROM orders"""
)
def scalar_date_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Dates against years, months and days."""
    from skein.functions import text as T

    met = lambda b: T.within_dates(F.col("o_orderdate").cast("date"), F.lit(b))
    return table(spark, d, "orders").select("o_orderkey", met("<=1996").alias("upto"), met(">=1995.03.01").alias("since"), met("<1997").alias("before"), met(">1995.03").alias("after"), met("=1995.3").alias("month"))


@query(
    """SELECT p_partkey, name, CASE name WHEN 'sin' THEN 'Math' WHEN '+' THEN 'Arith' WHEN 'sum' THEN 'Summary' WHEN '&' THEN 'Logic' END AS "group" FROM part,
    LATERAL (SELECT CASE p_size % 5 WHEN 0 THEN 'sin' WHEN 1 THEN '+' WHEN 2 THEN 'sum' WHEN 3 THEN '&' ELSE 'lm' END AS name)"""
)
def scalar_group_generics(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions import text as T

    name = F.element_at(F.array(*map(F.lit, ("sin", "+", "sum", "&", "lm"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), T.group_generic(name).alias("group"))


@query(
    """SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE p_type END AS kind, sha256(p_name) AS hash, CAST(2 AS INTEGER) AS keys FROM part"""
)
def scalar_records(spark: SparkSession, d: str) -> DataFrame:
    """Records: the right one's values win, keys without a value go; and a digest of a text."""
    from skein.functions import text as T

    left = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    right = F.create_map(F.lit("kind"), F.when(F.col("p_size") % 2 == 0, "new"), F.lit("gone"), F.lit(None).cast("string"))
    both = T.merged(left, right)
    return table(spark, d, "part").select("p_partkey", both["brand"].alias("brand"), both["kind"].alias("kind"), T.content_hash(F.col("p_name")).alias("hash"), F.size(both).alias("keys"))
