"""Sequence operators over ordered rows of a key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def step(x: str, w) -> Column:
    return F.col(x) - F.lag(x).over(w)


def gradient(x: str, t: str, w) -> Column:
    """Central difference for uneven spacing, one-sided at the ends, null for a single row."""
    f0, f1, f2 = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    h, k = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    inner = (h * h * f2 + (k * k - h * h) * f1 - k * k * f0) / (h * k * (h + k))
    return F.when(h.isNull(), (f2 - f1) / k).when(k.isNull(), (f1 - f0) / h).otherwise(inner)


def wrapped(x: Column, period: float = 360.0) -> Column:
    return F.pmod(x + period / 2, F.lit(period)) - period / 2


def unwrapped(df: DataFrame, x: str, w, out: str) -> DataFrame:
    """Angle made continuous: the first value and the sum of wrapped steps."""
    a = df.withColumn("_d", F.coalesce(wrapped(F.col(x) - F.lag(x).over(w)), F.lit(0.0))).withColumn("_f", F.first(x).over(w))
    return a.withColumn(out, F.col("_f") + F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d", "_f")


def running(x: str, w) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def moving_average(x: str, width: int, w) -> Column:
    """Centred, zeros beyond the ends, always divided by the width."""
    h = width // 2
    return F.sum(x).over(w.rowsBetween(-h, h)) / width


def sliding(df: DataFrame, key: str, index: str, value: str, length: int, stride: int, label_after: bool = False, drop_last: bool = False) -> DataFrame:
    """Windows of ``length`` rows at every ``stride``-th start: ``key, start, end, window, label_index``.

    ``label_after``: the label is that of the row after the window, which must exist; else of its last row.
    ``drop_last``: the last full window is left out.

    Rows are put together in blocks of a stride first, so that a window is made at its start alone and of blocks; all
    steps share one shuffle by key. Nulls keep their places.
    """
    a = df.withColumns({"_n": F.count("*").over(Window.partitionBy(key)), "_i": F.row_number().over(by(key, index)) - 1})
    block = a.groupBy(key, F.floor(F.col("_i") / stride).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("v")))).alias("_v"), F.first("_n").alias("_n"))
    ahead = by(key, "_b").rowsBetween(0, (length - 1) // stride)
    block = block.withColumns({"_w": F.flatten(F.collect_list("_v").over(ahead)), "start": F.col("_b") * stride})
    last = F.col("_n") - length - (1 if label_after or drop_last else 0)
    window = F.transform(F.slice("_w", 1, length), lambda x: x["v"]).alias("window")
    return block.where(F.col("start") <= last).select(key, "start", (F.col("start") + length - 1).alias("end"), window, (F.col("start") + length - (0 if label_after else 1)).alias("label_index"))


def islands(df: DataFrame, key: str, order: str, breaks: Column, out: str = "island") -> DataFrame:
    """Numbers the runs between breaks; a row where ``breaks`` holds starts one."""
    w = by(key, order)
    return df.withColumn("_b", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn(out, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def clock_runs(df: DataFrame, key: str, order: str, t: str, most: float, least_rows: int) -> DataFrame:
    """Runs between clock breaks (step missing, not positive or over ``most``) with at least so many rows."""
    d = F.col(t) - F.lag(t).over(by(key, order))
    runs = islands(df, key, order, F.lag(t).over(by(key, order)).isNotNull() & ((d <= 0) | (d > most)), "run").groupBy(key, "run").agg(F.count("*").alias("n"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    return runs.where(F.col("n") >= least_rows)


def held_time(df: DataFrame, key: str, order: str, t: str, holds: Column, out: str = "held") -> DataFrame:
    """Time for which a condition has held without a break, zero while it doesn't."""
    w = by(key, order)
    a = df.withColumn("_h", F.coalesce(holds, F.lit(False))).withColumn("_dt", F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0)))
    a = islands(a, key, order, ~F.col("_h"), "_run")
    inside = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return a.withColumn(out, F.when(F.col("_h"), F.sum(F.when(F.col("_h"), F.col("_dt")).otherwise(0.0)).over(inside)).otherwise(0.0)).drop("_h", "_dt", "_run")


def throttled(df: DataFrame, key: str, t: str, period: float) -> DataFrame:
    """Rows that are at least ``period`` after the last one let through, from the first on.

    Each choice hangs on the one before, so a series is folded in order; rows of a time that was let through go.
    """
    schema = df.schema

    def fold(pdf):
        pdf = pdf.sort_values(t, kind="stable")
        times, keep, at = pdf[t].to_numpy(float), [], 0
        while at < len(times):  # from each emission straight to the next
            keep.append(at)
            at = int(np.searchsorted(times, times[at] + period))
        return pdf.iloc[keep]

    return df.groupBy(key).applyInPandas(fold, schema)


def tiles(span: DataFrame, key: str, t0: str, t1: str, length: float, stride: float) -> DataFrame:
    """``key, k, start, end``: windows of a length, each a stride after the other, as far as they fit."""
    n = F.floor((F.col(t1) - F.col(t0) - length) / stride + 1e-9).cast("int")
    return span.where(F.col(t1) - F.col(t0) >= length).select(key, t0, F.explode(F.sequence(F.lit(0), n)).alias("k")).select(key, "k", (F.col(t0) + F.col("k") * stride).alias("start"), (F.col(t0) + F.col("k") * stride + length).alias("end"))
