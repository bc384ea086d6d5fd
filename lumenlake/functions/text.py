"""Texts of values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def general(x: Column) -> Column:
    """A double as C's %g prints it: six significant digits, no trailing zeros.

    The digits come from a decimal string of the rounded value; exponents below -4 and from 6 on
    are written in scientific form.
    """
    shown = F.format_string("%.5e", x.cast("double"))
    mantissa, power = F.regexp_extract(shown, r"^(-?[0-9.]+)e", 1), F.regexp_extract(shown, r"e([+-][0-9]+)$", 1).cast("int")
    trim = lambda s: F.regexp_replace(F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, "0+$", "")).otherwise(s), r"\.$", "")
    fixed = [F.when(power == p, F.format_string(f"%.{5 - p}f", x.cast("double"))) for p in range(-4, 6)]
    plain = F.coalesce(*fixed)
    science = F.concat(trim(mantissa), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(x.isNull(), None).when(x == 0, "0").when(power.between(-4, 5), trim(plain)).otherwise(science)


def file_size(n: Column) -> Column:
    """Bytes in decimal units with two digits, rounded half to even on the exact quotient; null if negative.

    In whole numbers: a decimal quotient of so many digits is cut to six after the point, and would then be rounded twice.
    """
    units = ("KB", "MB", "GB", "TB")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))
    n = n.cast("bigint")
    out = F.when(n < 0, None).when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        cent = 10 ** (3 * k - 2)
        whole, rest = div(n, cent), n % cent
        cents = whole + ((2 * rest > cent) | ((2 * rest == cent) & (whole % 2 == 1))).cast("bigint")
        text = F.concat(div(cents, 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        out = out.otherwise(text) if k == len(units) else out.when(n < 1000 ** (k + 1), text)
    return out


def html(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def strip_or_null(s: Column) -> Column:
    bare = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def yes_no(b: Column) -> Column:
    """YES, NO, or empty where unknown."""
    return F.when(b, "YES").when(~b, "NO").otherwise("")


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fit(s: Column, width: int) -> Column:
    """Cut to ``width`` with an ellipsis, then padded."""
    return F.rpad(F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 1), F.lit("…"))).otherwise(s), width, " ")


def bar(points: Column, width: int = 20) -> Column:
    filled = F.floor((points * width + 50) / 100).cast("int")
    return F.concat(F.expr("''"), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def shutter(x: Column) -> Column:
    """Seconds with eight digits, and the reciprocal where below one."""
    plain = F.format_string("%.8f s", x.cast("double"))
    return F.when((x > 0) & (x < 1), F.concat(plain, F.lit(" (~1/"), F.bround(1 / x, 0).cast("bigint").cast("string"), F.lit(" s)"))).otherwise(plain)


def trim_zeros(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def hex_bytes(b: Column) -> Column:
    """Hex digits of bytes, two by two."""
    return F.regexp_replace(F.hex(b), "(..)(?=.)", "$1 ")


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def clean_name(path: Column) -> Column:
    """Default name of a sanitised file: ``_clean`` before the suffix, or ``_clean.jpg`` after a name without one."""
    has = path.rlike(r"[^/.][^/]*\.[^/.]+$")
    return F.when(has, F.regexp_replace(path, r"(\.[^/.]+)$", "_clean$1")).otherwise(F.concat(path, F.lit("_clean.jpg")))
