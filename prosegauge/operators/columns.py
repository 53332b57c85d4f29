"""Statistics and vector operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(a: Column, b: Column) -> Column:
    """Positions where both vectors have a number."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x)
    return F.filter(F.arrays_zip(a.cast("array<double>").alias("a"), b.cast("array<double>").alias("b")), lambda p: ok(p["a"]) & ok(p["b"]))


def _sum(pairs: Column, term) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda t, p: t + term(p))


def cosine(a: Column, b: Column) -> Column:
    """Null if nothing is left or a side is zero; vectors of unequal length are an error."""
    p = _pairs(a, b)
    norm = F.sqrt(_sum(p, lambda x: x["a"] * x["a"])) * F.sqrt(_sum(p, lambda x: x["b"] * x["b"]))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double")).otherwise(_sum(p, lambda x: x["a"] * x["b"]) / F.nullif(norm, F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    p = _pairs(a, b)
    value = F.when(F.size(p) > 0, F.sqrt(_sum(p, lambda x: (x["a"] - x["b"]) * (x["a"] - x["b"]))))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double")).otherwise(value)


def midrank(values: Column, x: Column) -> Column:
    """Percentile of x in an array of reference values, ties counting half."""
    less, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return 100.0 * (less + 0.5 * same) / F.nullif(F.size(values), F.lit(0))


def two_sided_p(share: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(2 * F.least(share, 1 - share), 1 / (n + 1)))


def grid_share(grid: Column, x: Column) -> Column:
    """Where x lies in an ascending quantile grid, from 0 to 1; in a flat run its middle."""
    n = F.size(grid) - 1
    below, upto = F.size(F.filter(grid, lambda v: v < x)), F.size(F.filter(grid, lambda v: v <= x))
    left, right = F.get(grid, below - 1), F.get(grid, below)
    inside = (below - 1 + (x - left) / (right - left)) / n
    return F.when(x < F.get(grid, F.lit(0)), F.lit(0.0)).when(x > F.get(grid, n), F.lit(1.0)).when(upto > below, (below + upto - 1) / 2.0 / n).otherwise(inside)


def band(value: Column, bands: list[tuple[str, float | None]], rising: bool = False) -> Column:
    """The first band whose limit holds: value <= limit, or >= limit if rising; None holds always."""
    out = F.lit(None).cast("string")
    for name, limit in reversed(bands):
        out = F.lit(name) if limit is None else F.when(value >= limit if rising else value <= limit, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def interpolate(xs: Column, ys: Column, at: Column) -> Column:
    """Linear interpolation of (xs, ys), xs ascending, clamped at both ends."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda v: v <= at))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k >= n, F.get(ys, n - 1)).otherwise(y0 + (y1 - y0) * (at - x0) / (x1 - x0))
