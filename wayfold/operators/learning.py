"""Signals, training sets and networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.metrics import correlation


def correlation_lag(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """The shift of ``b`` against ``a`` with the highest correlation, by one transform; missing values count as the mean, and fewer than 16 rows have none."""
    if min(len(a), len(b)) < 16:
        return 0, 0.0
    a, b = (np.where(np.isfinite(x), x, np.nanmean(x)) - np.nanmean(x) for x in (a, b))
    n = 1 << (len(a) + len(b) - 2).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)
    lags = np.arange(-len(b) + 1, len(a))
    values = full[lags % n]
    k = int(np.argmax(values))
    size = float(np.sqrt((a @ a) * (b @ b)))
    return int(lags[k]), float(values[k] / size) if size else 0.0


def lags(series: DataFrame, key: str, order: str, a: str, b: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        lag, peak = correlation_lag(pdf[a].to_numpy(float), pdf[b].to_numpy(float))
        return pd.DataFrame([(pdf[key].iloc[0], lag, peak)], columns=[key, "lag", "peak"])

    return series.groupBy(key).applyInPandas(run, f"{key} {dict(series.dtypes)[key]}, lag long, peak double")


def frame_moments(rows: DataFrame, key: str, x: tuple[str, str, str], y: str) -> DataFrame:
    """Least squares of ``y`` on three axes for each run, from one pass of sums, with the fit's correlation.

    ``w0, w1, w2`` solve the 3 x 3 normal equations by Cramer's rule; null where they have no single answer.
    """
    s = {f"s{i}{j}": F.sum(F.col(x[i]) * F.col(x[j])) for i in range(3) for j in range(i, 3)} | {f"t{i}": F.sum(F.col(x[i]) * F.col(y)) for i in range(3)}
    m = rows.groupBy(key).agg(*(v.alias(k) for k, v in s.items()))
    a = [[F.col(f"s{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    t = [F.col(f"t{i}") for i in range(3)]

    def det(q):
        return q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1]) - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0]) + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])

    whole = F.nullif(det(a), F.lit(0.0))
    w = m.select(key, *((det([[t[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]) / whole).alias(f"w{k}") for k in range(3)))
    fit = rows.join(w, key).withColumn("_p", sum(F.col(f"w{k}") * F.col(x[k]) for k in range(3)))
    return w.join(fit.groupBy(key).agg(correlation("_p", y).alias("r")), key)


def upsampled(windows: DataFrame, fast: str, order: str, share: float = 0.3, most: int = 3) -> DataFrame:
    """Fast windows repeated until they make up the share, each at most so many times; copies are numbered by ``copy``."""
    n = windows.agg(F.count("*").alias("n"), F.count(F.when(F.col(fast), 1)).alias("f"))
    times = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(share * (F.col("n") - F.col("f")) / ((1 - share) * F.nullif(F.col("f"), F.lit(0))))))
    copies = F.when(F.col(fast), F.coalesce(times, F.lit(1))).otherwise(F.lit(1)).cast("int")
    return windows.crossJoin(F.broadcast(n)).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("n", "f")


def split_by_run(runs: DataFrame, run: str, size: str, share: float = 0.2) -> DataFrame:
    """``split``: the largest runs make the validation part while what stands before them is below the share."""
    w = Window.orderBy(F.desc(size), run)  # one row for each run
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(Window.partitionBy())
    return runs.withColumn("split", F.when(before < share * total, "val").otherwise("train"))


def augmented(windows: DataFrame, key: str, gain: float = 0.05, noise: float = 0.02) -> DataFrame:
    """Windows (``x, y`` arrays) turned in the plane, scaled and roughened by amounts that hang on the key alone."""
    unit = lambda salt: (F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0)
    a = windows.withColumns({"_a": unit(1) * 2 * np.pi, "_g": 1 + gain * (2 * unit(2) - 1), "_n": noise * (2 * unit(3) - 1)})
    turned = F.expr("zip_with(x, y, (p, q) -> named_struct('x', _g * (cos(_a) * p - sin(_a) * q) + _n, 'y', _g * (sin(_a) * p + cos(_a) * q) + _n))")
    a = a.withColumn("_t", turned)
    return a.withColumns({"x": F.expr("transform(_t, p -> p.x)"), "y": F.expr("transform(_t, p -> p.y)")}).drop("_a", "_g", "_n", "_t")


def receptive_field(dilations: list[int], kernel: int = 3, convolutions: int = 2) -> int:
    return 1 + convolutions * (kernel - 1) * sum(dilations)
