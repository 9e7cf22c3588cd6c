"""Names, patterns, dates and records as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: POSIX classes of patterns and what they hold, as ranges of a bracket expression.
POSIX = {
    "digit": "0-9", "lower": "a-z", "upper": "A-Z", "alpha": "A-Za-z", "alnum": "A-Za-z0-9", "space": r"\s", "blank": r" \t", "xdigit": "A-Fa-f0-9",
    "punct": r"!-/:-@\[-`{-~", "cntrl": r"\x00-\x1F\x7F", "graph": r"\x21-\x7E", "print": r"\x20-\x7E", "word": "A-Za-z0-9_", "ascii": r"\x00-\x7F",
}
#: Points of a name that is offered for what was typed.
EXACT, SAME_LETTERS, KNOWN, IN_BASE, BASE_ITSELF = 3000, 900, 500, 40, 20
VARIABLE, SHORT, REPLACING, DOTTED, METHOD, OPERATOR, SHOUTING, HIDDEN = -20, -40, -35, -45, -30, -60, -30, -400
#: The members that a group generic stands for.
GROUPS = {
    "Arith": ("+", "-", "*", "/", "^", "**", "%%", "%/%"), "Compare": ("==", "!=", "<", "<=", ">", ">="), "Logic": ("&", "|"),
    "Math": ("abs", "sign", "sqrt", "floor", "ceiling", "trunc", "exp", "expm1", "log", "log2", "log10", "log1p", "cos", "sin", "tan", "cosh", "sinh", "tanh", "acos", "asin", "atan", "acosh", "asinh", "atanh", "cumsum", "cumprod", "cummax", "cummin"),
    "Math2": ("round", "signif"), "Summary": ("any", "sum", "prod", "min", "max", "range"), "Complex": ("Re", "Im", "Mod", "Arg", "Conj"),
}


def pattern(text: Column) -> Column:
    """A pattern of the analysed language as one of Java's: POSIX classes become ranges, a star or plus in front repeats
    any character."""
    for name, ranges in POSIX.items():
        text = F.replace(text, F.lit(f"[:{name}:]"), F.lit(ranges))
    return F.when(text.rlike(r"^[*+]"), F.concat(F.lit("."), text)).otherwise(text)


def name_rank(name: Column, needle: Column, place: Column, downloads: Column, base: Column, known: Column, method: Column, variable: Column) -> Column:
    """How well a name answers what was typed: higher is offered first. `place` is how far down the match sits, from 0;
    base: NULL for no package of the language, else whether it is the base package itself."""
    typed = needle != ""
    score = -place * 150 - F.when(typed, F.length(name) * 12).otherwise(0) + F.least(F.log10(downloads + 10), F.lit(8.0)) * F.when(typed, 4).otherwise(12)
    rules = (
        (EXACT, name == needle), (SAME_LETTERS, (name != needle) & (F.lower(name) == F.lower(needle))), (IN_BASE, base.isNotNull() & (F.length(name) >= 3)), (VARIABLE, variable),
        (SHORT, F.length(name) < 3), (REPLACING, name.endswith("<-")), (DOTTED, name.contains(".") & ~needle.contains(".")), (BASE_ITSELF, base), (KNOWN, known), (METHOD, method),
        (OPERATOR, name.rlike(r"^%.*%$|^[^\w.]")), (SHOUTING, (name == F.upper(name)) & name.rlike("[A-Z]") & (name != needle)), (HIDDEN, name.startswith(".")),
    )
    for points, holds in rules:
        score = score + F.when(F.coalesce(holds, F.lit(False)), points).otherwise(0)
    return score


def date_window(text: Column) -> Column:
    """struct<first, last> of the days that `YYYY`, `YYYY.MM` or `YYYY.MM.DD` names; NULL for what is none."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^((?:19|20)\d{2})(?:\.(\d{1,2}))?(?:\.(\d{1,2}))?$", i)
    year, month, day = part(1), F.nullif(part(2), F.lit("")), F.nullif(part(3), F.lit(""))
    first = F.try_to_date(F.concat_ws("-", year, F.lpad(F.coalesce(month, F.lit("1")), 2, "0"), F.lpad(F.coalesce(day, F.lit("1")), 2, "0")), "yyyy-MM-dd")
    last = F.when(day.isNotNull(), first).when(month.isNotNull(), F.last_day(first)).otherwise(F.add_months(first, 12) - F.expr("interval 1 day"))
    return F.when(first.isNotNull(), F.struct(first.alias("first"), last.cast("date").alias("last")))


def within_dates(date: Column, bound: Column) -> Column:
    """Whether a date meets a bound such as `<=2021.05`; a missing date meets none, and NULL where it is no bound."""
    sign, window = F.regexp_extract(bound, r"^\s*(<=|>=|<|>|=)", 1), date_window(F.regexp_replace(bound, r"^\s*(<=|>=|<|>|=)\s*", ""))
    first, last = window["first"], window["last"]
    met = F.when(sign == "<=", date <= last).when(sign == ">=", date >= first).when(sign == "<", date < first).when(sign == ">", date > last).when(sign == "=", (date >= first) & (date <= last))
    return F.when(window.isNotNull() & (sign != ""), F.coalesce(met, F.lit(False)))


def group_generic(name: Column) -> Column:
    """The group generic that a function is a member of, or NULL."""
    out = F.lit(None).cast("string")
    for group, members in GROUPS.items():
        out = F.when(name.isin(*members), F.lit(group)).otherwise(out)
    return out


def compacted(record: Column) -> Column:
    """A map without the keys that have no value."""
    return F.map_filter(record, lambda _, v: v.isNotNull())


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key the right one's value wins, unless it has none."""
    kept = F.map_filter(left, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(compacted(right)), k), F.lit(False)))
    return F.map_concat(kept, compacted(right))


def content_hash(text: Column) -> Column:
    """A digest that tells contents apart."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
