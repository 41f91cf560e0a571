"""Soft scores, flags and quality rules over nullable, possibly NaN columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    """NaN as null: a missing vote passes no comparison."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def at_least(c: Column, threshold: float | Column) -> Column:
    return F.coalesce(known(c) >= threshold, F.lit(False))


def finite(c: Column) -> Column:
    x = known(c)
    return F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False))


def path_flag(parent: Column, *children: Column, threshold: float) -> Column:
    """Parent and every child reach the threshold, which lies in (0.5, 1]."""
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must lie in (0.5, 1]")
    out = at_least(parent, threshold)
    for c in children:
        out = out & at_least(c, threshold)
    return out


def first_tier(*tiers: tuple[str, Column]) -> Column:
    out = F.when(tiers[0][1], tiers[0][0])
    for name, flag in tiers[1:]:
        out = out.when(flag, name)
    return out


def path_strength(*votes: Column) -> Column:
    """The weakest vote, votes that aren't finite as 0, clipped to [0, 1]."""
    sound = [F.when(finite(v), v.cast("double")).otherwise(0.0) for v in votes]
    low = F.least(*sound) if len(sound) > 1 else sound[0]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), low))


def interval_score(z: Column, low: Column | float, high: Column | float) -> Column:
    """1 on the closed interval, else exp(-distance / half width)."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.exp(-F.greatest(low - z, z - high, F.lit(0.0)) / ((high - low) / 2))


def in_interval(z: Column, low: Column | float, high: Column | float) -> Column:
    return (z >= low) & (z < high)


def spectrum_reasons(zwarn: Column, z: Column, zerr: Column, least_z: float) -> Column:
    """Why a match is not valid, joined with semicolons; empty if it is."""
    return F.concat_ws(
        ";",
        F.when(~F.coalesce(zwarn == 0, F.lit(False)), "zwarn_not_zero"),
        F.when(~finite(z), "redshift_nonfinite").when(z < least_z, "redshift_below_minimum"),
        F.when(~finite(zerr), "redshift_error_nonfinite").when(zerr <= 0, "redshift_error_not_positive"),
    )


def cost(reported: Column, prompt_tokens: Column, completion_tokens: Column, rates: tuple[float, float]) -> Column:
    """The reported cost, else tokens at their rates per million; null where neither is known."""
    return F.coalesce(F.when(finite(reported), reported.cast("double")), (prompt_tokens * rates[0] + completion_tokens * rates[1]) / 1e6)
