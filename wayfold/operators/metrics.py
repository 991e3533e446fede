"""Aggregates of errors, drifts and tracks, as columns for ``agg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def bias(e: Column) -> Column:
    return F.avg(e)


def mae(e: Column) -> Column:
    return F.avg(F.abs(e))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Null where one of the two doesn't vary over the rows that have both."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))  # corr raises for constants


def pearson(p: str, t: str) -> Column:
    """Null where the prediction doesn't vary."""
    return F.when(F.stddev_pop(p) > 1e-9, correlation(p, t))


def spread_ratio(p: str, t: str) -> Column:
    return F.stddev_pop(p) / F.nullif(F.stddev_pop(t), F.lit(0.0))


def score(p: str, t: str, least: int = 10) -> dict[str, Column]:
    """The score record: nothing but ``n`` below ``least`` rows."""
    e = F.col(p) - F.col(t)
    n = F.count(e)
    parts = {"rmse": rmse(e), "bias": bias(e), "mae": mae(e), "r": pearson(p, t), "constant_rmse": F.stddev_pop(t), "shrinkage": spread_ratio(p, t), "least": F.min(p), "most": F.max(p)}
    return {"n": n} | {k: F.when(n >= least, v) for k, v in parts.items()}


def last_of(x: str, order: str) -> Column:
    """The value of the last row that has one."""
    return F.max_by(F.col(x), F.when(F.col(x).isNotNull() & ~F.isnan(F.col(x)), F.col(order)))


def circular_mean(x: str) -> Column:
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(x))), F.avg(F.cos(F.radians(x)))))


def outage(error: str, order: str) -> dict[str, Column]:
    """Error at the end, signed sum, mean size for each second, and how many seconds."""
    return {"crse": last_of(error, order), "cae": F.sum(error), "aeps": F.avg(F.abs(error)), "seconds": F.count(error)}


def drift(error: str, distance: str, order: str) -> dict[str, Column]:
    end, metres = last_of(error, order), F.max(distance)
    return {"final": end, "most": F.max(error), "mean": F.avg(error), "percent": F.when(metres > 1, 100 * end / metres).otherwise(0.0)}


def extent(lat: str, lon: str, share: float, floor: float) -> dict[str, Column]:
    def pad(x, side):
        p = F.greatest((F.max(x) - F.min(x)) * share, F.lit(floor))
        return F.min(x) - p if side < 0 else F.max(x) + p

    return {"south": F.greatest(pad(lat, -1), F.lit(-85.0)), "north": F.least(pad(lat, 1), F.lit(85.0)), "west": F.greatest(pad(lon, -1), F.lit(-180.0)), "east": F.least(pad(lon, 1), F.lit(180.0))}


def standing_bias(x: str, still: Column, least: int = 100) -> Column:
    """Mean while standing; the median of all rows if there are fewer than ``least`` stops."""
    return F.when(F.count(F.when(still, 1)) >= least, F.avg(F.when(still, F.col(x)))).otherwise(F.percentile(x, F.lit(0.5)))


def still_mean(x: str, still: Column, least: int = 50) -> Column:
    """Mean while standing; 0 unless there are more than ``least`` such rows."""
    return F.when(F.count(F.when(still, 1)) > least, F.avg(F.when(still, F.col(x)))).otherwise(0.0)
