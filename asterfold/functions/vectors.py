"""Arithmetic of array columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def is_unit(a: Column, atol: float = 1e-3) -> Column:
    return F.abs(norm(a) - 1.0) <= atol


def normalized(a: Column) -> Column:
    """Unit vector as floats; null where the norm is zero or not finite."""
    n = norm(a)
    fine = (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(fine, F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def fused(*vectors: Column) -> Column:
    return F.concat(*vectors)


def all_close(a: Column, b: Column, rtol: float = 0.0, atol: float = 1e-6) -> Column:
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False)))


def checksum(a: Column) -> Column:
    """Content hash of a vector: its JSON text, so equal floats give equal sums."""
    return F.sha2(F.to_json(a), 256)


def resampled(values: Column, wave: Column, grid: Column) -> Column:
    """Linear interpolation of (wave, values) on the grid, flat beyond the ends. wave ascends."""

    def at(g: Column) -> Column:
        right = F.size(F.filter(wave, lambda w: w <= g))
        n = F.size(wave)
        lo, hi = F.get(wave, right - 1), F.get(wave, right)
        a, b = F.get(values, right - 1).cast("double"), F.get(values, right).cast("double")
        return F.when(right == 0, F.get(values, F.lit(0)).cast("double")).when(right >= n, F.get(values, n - 1).cast("double")).otherwise(a + (b - a) * (g - lo) / (hi - lo))

    return F.transform(grid, at)


def continuum_log(flux: Column, window: int, floor: float = 1e-3) -> Column:
    """log of flux over its sliding median (edges repeat the nearest value), ratios floored; 0 where the median isn't positive."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2

    def ratio(x: Column, k: Column) -> Column:
        around = F.transform(F.sequence(k - half, k + half), lambda j: F.get(flux, F.least(F.greatest(j, F.lit(0)), F.size(flux) - 1)).cast("double"))
        middle = F.get(F.array_sort(around), F.lit(half))
        share = F.when(middle > 0, F.nanvl(x.cast("double") / middle, F.lit(1.0))).otherwise(1.0)
        return F.log(F.greatest(share, F.lit(floor)))

    return F.transform(flux, ratio)
