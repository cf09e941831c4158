"""Statistics as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959964


def rate(part: Column, whole: Column, digits: int | None = 6) -> Column:
    out = part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")
    return out if digits is None else F.round(out, digits)


def wilson(k: Column, n: Column, upper: bool, digits: int = 6) -> Column:
    """A bound of the Wilson score interval, within 0 and 1; 0 if n is not positive."""
    k, n = k.cast("double"), n.cast("double")
    z2 = Z * Z
    safe = F.greatest(n, F.lit(1.0))
    p = k / safe
    spread = Z * F.sqrt(p * (1 - p) / safe + z2 / (4 * safe * safe))
    middle = p + z2 / (2 * safe)
    bound = (middle + spread if upper else middle - spread) / (1 + z2 / safe)
    return F.when(n <= 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), bound)), digits))


def mcnemar_p(improved: Column, regressed: Column) -> Column:
    """The exact two-sided p-value, as a running product over the smaller tail, in logs so that any count works."""

    def exact(a: Column, b: Column) -> Column:
        d, tail = a + b, F.least(a, b)
        start = F.struct((-d * math.log(2)).cast("double").alias("term"), F.exp(-d * math.log(2)).cast("double").alias("sum"))
        step = lambda acc, i: F.struct((acc["term"] + F.log((d - i + 1).cast("double") / i)).alias("term"), (acc["sum"] + F.exp(acc["term"] + F.log((d - i + 1).cast("double") / i))).alias("sum"))
        total = F.when(tail > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(tail, F.lit(1)).cast("long")), start, step, lambda acc: acc["sum"])).otherwise(F.exp(-d * math.log(2)))
        return F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))

    return exact(improved.cast("long"), regressed.cast("long"))


def nearest_rank(c: Column, fraction: float) -> Column:
    """The element at rank ceil(fraction * n)."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {c._jc.toString()})")
