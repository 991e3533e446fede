"""Training losses as aggregates over windows, in one pass by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import scalars

#: Weights of the terms, step of a window's samples, longest gap of windows that follow each other.
WEIGHTS = dict(displacement=1.0, stationary=0.5, physics=0.3, yaw=0.2, smoothness=0.1, nhc=0.05)
DT, GAP_S = 0.1, 1.5


def physics(v: str, a: str, dt: float = DT) -> Column:
    """Sum of the squared differences of each step's speed from the one before and its acceleration, and how many there are."""
    steps = F.size(v) - 1
    gaps = F.transform(F.sequence(F.lit(1), steps), lambda k: F.get(v, k) - F.get(v, k - 1) - F.get(a, k - 1) * dt)
    squares = F.aggregate(F.when(steps > 0, gaps).otherwise(F.array().cast("array<double>")), F.lit(0.0), lambda t, x: t + x * x)
    return F.struct(squares.alias("s"), F.greatest(steps, F.lit(0)).alias("n"))


def sideways(v: str, rates: str, dt: float = DT) -> Column:
    """Sum of the squared speeds to the side that a window's turns imply, and how many there are."""
    turned = F.transform(F.sequence(F.lit(1), F.size(rates)), lambda k: F.aggregate(F.slice(rates, 1, k), F.lit(0.0), lambda t, x: t + x * dt))
    squares = F.aggregate(turned, F.lit(0.0), lambda t, x: t + F.pow(F.col(v) * F.sin(x), F.lit(2)))
    return F.struct(squares.alias("s"), F.size(rates).alias("n"))


def multitask(windows: DataFrame, batch: str, session: str, order: str, t0: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``batch`` and the six terms with their weighted ``total``.

    Windows hold ``mu, logvar, displacement, weight, logit, stationary, yaw_rate, true_yaw`` and the arrays ``v_seq, a_seq,
    gyro_yaw``. Stand-stills weigh negatives by positives; yaw counts where the truth is known; smoothness where two windows
    of a session follow each other within 1.5 s. A term without rows is 0.
    """
    c = WEIGHTS | (weights or {})
    w = Window.partitionBy(batch, session).orderBy(order)
    gap = F.col(t0) - F.lag(t0).over(w)
    a = windows.withColumns({"_smooth": F.when((gap > 0) & (gap <= GAP_S), F.abs(F.col("mu") - F.lag("mu").over(w))), "_p": physics("v_seq", "a_seq"), "_s": sideways("mu", "gyro_yaw")})
    positive = F.sum(F.col("stationary").cast("double")).over(Window.partitionBy(batch))
    n = F.count("*").over(Window.partitionBy(batch))
    a = a.withColumn("_pw", F.when(positive > 0, (n - positive) / F.nullif(positive, F.lit(0.0))).otherwise(1.0))
    known = F.nanvl(F.col("true_yaw"), F.lit(None).cast("double"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    terms = {
        "displacement": F.sum(F.expr(scalars.gaussian_nll("mu", "logvar", "displacement")) * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-8)),
        "stationary": F.avg(F.expr(scalars.bce_with_logits("logit", "CAST(stationary AS DOUBLE)", "_pw"))),
        "physics": zero(F.sum("_p.s") / F.nullif(F.sum("_p.n"), F.lit(0))),
        "yaw": zero(F.avg(F.abs(F.col("yaw_rate") - known))),
        "smoothness": zero(F.avg("_smooth")),
        "nhc": zero(F.sum("_s.s") / F.nullif(F.sum("_s.n"), F.lit(0))),
    }
    out = a.groupBy(batch).agg(*(v.alias(k) for k, v in terms.items()))
    return out.withColumn("total", sum(F.lit(c[k]) * F.col(k) for k in terms))
