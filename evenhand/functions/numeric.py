"""Small column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(col: Column) -> Column:
    """Numeric column as double, with NaN turned into NULL."""
    d = col.cast("double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d)


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den as double; ``default`` when the denominator is 0 or NULL."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def binary(name: str) -> Column:
    """A 0/1 column (or boolean) as int; any other value than 0, 1 and NULL ends the query."""
    c = F.col(name).cast("double")
    wrong = F.raise_error(F.concat(F.lit(f"'{name}' is not 0/1: "), F.col(name).cast("string"))).cast("int")
    return F.when(c.isNull() | F.isnan(c), F.lit(None).cast("int")).when(c.isin(0.0, 1.0), c.cast("int")).otherwise(wrong)


def cap1(col: Column) -> Column:
    return F.least(col, F.lit(1.0))


def flag(cond: Column) -> Column:
    """Boolean as 0/1 int, NULL counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def argmax(value: Column | str, by: Column) -> Column:
    """Value at the largest ``by``; ties go to the smallest value."""
    return F.min_by(value, F.struct(-by, F.col(value) if isinstance(value, str) else value))


def argmin(value: Column | str, by: Column) -> Column:
    """Value at the smallest ``by``; ties go to the smallest value."""
    return F.min_by(value, F.struct(by, F.col(value) if isinstance(value, str) else value))


def level3(value: Column, cuts: list[tuple[str, float]], last: str) -> Column:
    """First label whose bound lies above ``value`` (strictly), else ``last``."""
    out = None
    for label, bound in cuts:
        cond = value < F.lit(float(bound))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(last)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
