"""Alignment of time series: as-of joins and resampling by one pass over the merged, ordered rows of each series.

No operator here joins by a range of times: rows of both sides are united, ordered once for each key, and the last or next
value is carried over. Nulls in the value are left out; a null time never aligns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Grid rows with ``prev`` and ``next`` (t, v) of the samples at or around their time."""
    g = grid.where(F.col(t).isNotNull()).withColumn("_s", F.lit(None).cast("struct<t:double,v:double>")).withColumn("_grid", F.lit(1))
    s = samples.where(f"`{t}` IS NOT NULL AND `{value}` IS NOT NULL").select(key, t, F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("_s"), F.lit(0).alias("_grid"))
    rows = g.unionByName(s, allowMissingColumns=True)
    order = [F.col(t), F.col("_grid")]
    back = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(key).orderBy(F.col(t), F.col("_grid").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumns({"prev": F.last("_s", True).over(back), "next": F.first("_s", True).over(ahead), "_n": F.count("_s").over(Window.partitionBy(key))}).where("_grid = 1").drop("_s", "_grid")


def interpolate(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str, inside_only: bool = False) -> DataFrame:
    """``grid`` with ``value`` interpolated at its times; beyond the ends it is held, or null if ``inside_only``.

    Fewer than two samples of a series give null.
    """
    m = _merged(grid, samples, key, t, value)
    x = F.col(t).cast("double")
    between = F.when(F.col("next.t") == F.col("prev.t"), F.col("prev.v")).otherwise(F.col("prev.v") + (F.col("next.v") - F.col("prev.v")) * (x - F.col("prev.t")) / F.nullif(F.col("next.t") - F.col("prev.t"), F.lit(0.0)))
    held = F.lit(None).cast("double") if inside_only else F.coalesce("prev.v", "next.v")
    return m.withColumn(value, F.when(F.col("_n") < 2, None).when(F.col("prev").isNotNull() & F.col("next").isNotNull(), between).otherwise(held)).drop("prev", "next", "_n")


def nearest_gap(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """``grid`` with ``gap``: the time to the nearest sample."""
    x = F.col(t).cast("double")
    return _merged(grid, samples, key, t, value).withColumn("gap", F.least(x - F.col("prev.t"), F.col("next.t") - x)).drop("prev", "next", "_n")


def latest(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Backward as-of: ``grid`` with the last value at or before its time."""
    return _merged(grid, samples, key, t, value).withColumn(value, F.col("prev.v")).drop("prev", "next", "_n")


def following(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Forward search: ``grid`` with the first value at or after its time."""
    return _merged(grid, samples, key, t, value).withColumn(value, F.col("next.v")).drop("prev", "next", "_n")


def uniform_grid(series: DataFrame, key: str, t: str, step: float) -> DataFrame:
    """``key, i, t`` from each series' first time to its last, by whole steps (no sum of steps)."""
    span = series.groupBy(key).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    n = F.floor((F.col("t1") - F.col("t0")) / step + 1e-9).cast("int")
    return span.select(key, "t0", F.explode(F.sequence(F.lit(0), n)).alias("i")).select(key, "i", (F.col("t0") + F.col("i") * step).alias(t))


def bucket_means(samples: DataFrame, keys: list[str], t_ns: str, values: list[str], width_ns: int = 100_000_000) -> DataFrame:
    """Means of the values in buckets of the clock."""
    return samples.groupBy(*keys, F.floor(F.col(t_ns) / width_ns).cast("long").alias("bucket")).agg(*(F.avg(v).alias(v) for v in values))


def bucket_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, [*keys, "bucket"])


def zipped(left: DataFrame, right: DataFrame, key: str, index: str, lag: int = 0) -> DataFrame:
    """Rows of equal index, the left being ahead by ``lag``; what has no partner goes."""
    return left.join(right.withColumn(index, F.col(index) + lag), [key, index])
