"""Column functions: parsing, guards, recoding. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded half up to ``digits`` places, the same in every engine with IEEE doubles."""
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit(10.0**digits)
    return F.floor(x.cast("double") * scale + F.lit(0.5)).cast("double") / scale


def leading_fields(x: Column, sep: str = "-", n: int = 3) -> Column:
    """The first ``n`` fields of an identifier."""
    return F.substring_index(x, sep, n)


def field_or(x: Column, sep: str, n: int, default: str) -> Column:
    """Field ``n`` (from 1), or ``default`` where the separator is absent."""
    return F.when(F.contains(x, F.lit(sep)), F.split_part(x, F.lit(sep), F.lit(n))).otherwise(F.lit(default))


def strip_version(x: Column) -> Column:
    return F.substring_index(x, ".", 1)


def starts_with_any(x: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(x, F.lit(p)) for p in prefixes])


def contains_all(x: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(x, F.lit(p)) for p in parts])


def lenient_double(x: Column) -> Column:
    """A number, or null for anything that isn't one (sentinels in brackets, words, blanks)."""
    return x.try_cast("double")


def recode(x: Column, mapping: dict[str, object], default: object = None) -> Column:
    """Values by dictionary; unmapped ones become ``default``."""
    out = None
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def guarded_ratio(a: Column, b: Column, zero: Column | None = None) -> Column:
    """``a / b`` where ``b`` is not zero; else ``a`` itself (divisor one), or ``zero``."""
    return F.when(b == 0, a.cast("double") if zero is None else zero).otherwise(F.try_divide(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def threshold_status(x: Column, warn: float = 0.02, act: float = 0.05, names: tuple[str, str, str] = ("OK", "WARN", "CORRECTED")) -> Column:
    return F.when(x > act, names[2]).when(x > warn, names[1]).otherwise(names[0])


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "p<0.001").otherwise(F.concat(F.lit("p="), F.format_string("%.3f", p)))


def sign_label(x: Column, up: str = "UP", down: str = "DOWN") -> Column:
    """``up`` above zero, else ``down`` (zero included)."""
    return F.when(x > 0, up).otherwise(down)


def symbol_quality(x: Column) -> Column:
    """2 for a resolved symbol, 1 for a locus or non-coding placeholder, 0 for none or a bare accession."""
    return F.when(x.isNull() | (x == "") | F.startswith(x, F.lit("ENSG")), 0).when(x.rlike("^(LOC|LINC)"), 1).otherwise(2)


def unit_vector(a: Column) -> Column:
    """An array scaled to Euclidean length one; a zero array stays as it is."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
