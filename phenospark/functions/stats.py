"""Column expressions with the statistics' conventions: sample variance, bias-corrected skewness, null for undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """NaN becomes null, so that comparisons treat it as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def skewness(c: Column | str) -> Column:
    """Aggregate: skewness with the small-sample correction (type 2); null below three values or without variance."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, b)
