"""Scalar functions of the analysed language as Column functions.

Numbers are doubles. An operation whose result is not finite has no value: NULL, as an unknown one has. String functions
count code points. Elementwise forms over arrays come from vector(): equal lengths only, nothing is recycled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _d(x: Column) -> Column:
    return x.cast("double")


def divide(a: Column, b: Column) -> Column:
    return finite(F.try_divide(_d(a), _d(b)))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    a, b = _d(a), _d(b)
    return F.when(b != 0, finite(a - b * F.floor(F.try_divide(a, b))))


def whole_divide(a: Column, b: Column) -> Column:
    return F.when(_d(b) != 0, F.floor(F.try_divide(_d(a), _d(b))).cast("double"))


def trunc(x: Column) -> Column:
    return F.when(_d(x) < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(_d(x), digits)


def signif(x: Column, digits: int = 6) -> Column:
    """x to a number of significant digits, 1 to 21; no value for others."""
    if not 1 <= digits <= 21:
        return F.lit(None).cast("double")
    x = _d(x)
    power = F.floor(F.log10(F.abs(x))) + 1 - digits
    scale = F.pow(F.lit(10.0), F.abs(power))
    return F.when(x == 0, F.lit(0.0)).when(power < 0, F.rint(x * scale) / scale).otherwise(F.rint(x / scale) * scale)


def log(x: Column, base: float | None = None) -> Column:
    x = F.when(_d(x) > 0, _d(x))
    return F.ln(x) if base is None else F.ln(x) / F.ln(F.lit(float(base)))


def _domain(f: Callable[[Column], Column], low: float = -float("inf"), high: float = float("inf"), open_: bool = False) -> Callable[[Column], Column]:
    def on(x: Column) -> Column:
        x = _d(x)
        inside = (x > low) & (x < high) if open_ else (x >= low) & (x <= high)
        return F.when(inside, finite(f(x)))

    return on


def _shift(x: Column, n: Column, left: bool) -> Column:
    """Shifts of 32-bit words; the count is taken modulo 32."""
    x, n = x.cast("int"), n.cast("int").bitwiseAND(F.lit(31))
    return F.call_function("shiftleft" if left else "shiftrightunsigned", x, n)


#: Functions of one number.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": _domain(F.abs), "sqrt": _domain(F.sqrt, 0), "floor": _domain(lambda x: F.floor(x).cast("double")),
    "ceiling": _domain(lambda x: F.ceil(x).cast("double")), "trunc": trunc, "sign": _domain(F.signum), "round": round_half_even,
    "signif": signif, "exp": _domain(F.exp), "expm1": _domain(F.expm1), "log": log, "log2": lambda x: log(x, 2),
    "log10": _domain(F.log10, 0, open_=True), "log1p": _domain(F.log1p, -1, open_=True), "sin": _domain(F.sin), "cos": _domain(F.cos),
    "tan": _domain(F.tan), "asin": _domain(F.asin, -1, 1), "acos": _domain(F.acos, -1, 1), "atan": _domain(F.atan),
    "sinh": _domain(F.sinh), "cosh": _domain(F.cosh), "tanh": _domain(F.tanh), "asinh": _domain(F.asinh),
    "acosh": _domain(F.acosh, 1), "atanh": _domain(F.atanh, -1, 1, open_=True), "-": lambda x: -_d(x), "+": _d,
    "bitwNot": lambda x: F.bitwise_not(x.cast("int")), "!": lambda x: ~x,
}

#: Functions of two values; comparisons of text have no value but for equality.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: finite(_d(a) + _d(b)), "-": lambda a, b: finite(_d(a) - _d(b)), "*": lambda a, b: finite(_d(a) * _d(b)),
    "/": divide, "^": lambda a, b: finite(F.pow(_d(a), _d(b))), "**": lambda a, b: finite(F.pow(_d(a), _d(b))), "%%": modulo,
    "%/%": whole_divide, "atan2": lambda y, x: F.atan2(_d(y), _d(x)), "bitwAnd": lambda a, b: a.cast("int").bitwiseAND(b.cast("int")),
    "bitwOr": lambda a, b: a.cast("int").bitwiseOR(b.cast("int")), "bitwXor": lambda a, b: a.cast("int").bitwiseXOR(b.cast("int")),
    "bitwShiftL": lambda a, n: _shift(a, n, True), "bitwShiftR": lambda a, n: _shift(a, n, False), "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b, "<": lambda a, b: _d(a) < _d(b), ">": lambda a, b: _d(a) > _d(b), "<=": lambda a, b: _d(a) <= _d(b),
    ">=": lambda a, b: _d(a) >= _d(b), "&&": lambda a, b: a & b, "||": lambda a, b: a | b,
    "&": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a & b), "|": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a | b),
    "xor": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a != b),
}


# text


def _known(*parts: Column) -> Column:
    cond = F.lit(True)
    for p in parts:
        cond = cond & p.isNotNull()
    return cond


def paste(*parts: Column, sep: str = " ") -> Column:
    """The parts' text with separators; no value where a part has none."""
    return F.when(_known(*parts), F.concat_ws(sep, *[p.cast("string") for p in parts]))


def paste0(*parts: Column) -> Column:
    return paste(*parts, sep="")


def file_path(*parts: Column, fsep: str = "/") -> Column:
    return paste(*parts, sep=fsep)


def here(*parts: Column) -> Column:
    return file_path(*parts) if parts else F.lit(".")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def dirname(path: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"/*[^/]*$", "")
    return F.when(~path.contains("/"), F.lit(".")).when(cut == "", F.when(path.startswith("/"), "/").otherwise(".")).otherwise(cut)


def trimws(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


#: Functions of one text.
TEXT: dict[str, Callable[[Column], Column]] = {"basename": basename, "dirname": dirname, "toupper": F.upper, "tolower": F.lower, "trimws": trimws, "nchar": F.char_length}


def is_absolute_path(x: Column) -> Column:
    """Unix, home, drive and network paths."""
    return x.rlike(r"^(/|~|[A-Za-z]:[\\/]|\\\\)")


def is_url(x: Column) -> Column:
    return x.rlike(r"^(?i)(https?|ftp|ftps|file)://\S+$")


# vectors


def combine(*arrays: Column) -> Column:
    """c(...): one vector of all elements."""
    return F.flatten(F.array(*arrays))


def sequence(a: Column, b: Column) -> Column:
    """a:b, upward or downward."""
    return F.sequence(a, b)


def vector(f: Callable[..., Column], *arrays: Column) -> Column:
    """f elementwise; no value where lengths differ or an element has none."""
    if len(arrays) == 1:
        out = F.transform(arrays[0], lambda x: f(x))
    else:
        same = F.size(arrays[0]) == F.size(arrays[1])
        out = F.when(same, F.zip_with(arrays[0], arrays[1], lambda a, b: f(a, b)))
    return F.when(~F.exists(out, lambda x: x.isNull()), out)


# three values: TRUE, NULL (maybe), FALSE


def all_true(x: Column) -> Column:
    """The conjunction of a group: FALSE wins, then maybe."""
    return F.when(F.bool_and(F.coalesce(x, F.lit(True))) == F.lit(False), F.lit(False)).when(F.count(F.when(x.isNull(), 1)) == 0, F.lit(True))


def any_true(x: Column) -> Column:
    return F.when(F.bool_or(F.coalesce(x, F.lit(False))), F.lit(True)).when(F.count(F.when(x.isNull(), 1)) == 0, F.lit(False))
