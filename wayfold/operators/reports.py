"""Reports over tracks: matches, integrators, channels, drifts, outages. Each is one or two aggregates by session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.functions.geo import METRES_PER_DEGREE
from wayfold.operators import align, metrics
from wayfold.operators.windows import by

#: Confidence from which a match is fed back, jump in metres, its longest time, rows between matches that follow each other.
CONFIDENT, JUMP_M, JUMP_S, NEIGHBOURS = 0.6, 15.0, 5.0, 40
#: Speeds from which a vehicle moves (integrator's report, baseline), accuracy of usable fixes, rows for a baseline.
MOVING, BASELINE_MOVING, USABLE_M, BASELINE_ROWS = 1.0, 2.0, 30.0, 50


def match_report(matches: DataFrame, key: str, correction: str = "correction", confidence: str = "confidence") -> DataFrame:
    """``matches, mean, median, p90, most`` of the correction in metres, ``mean_confidence`` and percent ``unsure``; nulls are left out."""
    c = F.when(~F.isnan(correction), F.col(correction))
    p = F.when(~F.isnan(confidence), F.col(confidence))
    return matches.groupBy(key).agg(
        F.count(c).alias("matches"),
        F.avg(c).alias("mean"),
        F.percentile(c, F.lit(0.5)).alias("median"),
        F.percentile(c, F.lit(0.9)).alias("p90"),
        F.max(c).alias("most"),
        F.avg(p).alias("mean_confidence"),
        (100 * F.avg(F.when(p < CONFIDENT, 1.0).when(p.isNotNull(), 0.0))).alias("unsure"),
    )


def snap_jumps(matches: DataFrame, key: str, order: str, t_s: str) -> DataFrame:
    """Matches (``snap_lat, snap_lon`` of ``dr_lat, dr_lon``) that moved on by more than 15 m beyond the integrator's own step within 5 s.

    Degrees of longitude are those at the session's mean latitude of snapped points.
    """
    w = by(key, order)
    scale = METRES_PER_DEGREE * F.cos(F.radians(F.avg("snap_lat").over(Window.partitionBy(key))))

    def hop(lat: str, lon: str) -> Column:
        return F.hypot((F.col(lon) - F.lag(lon).over(w)) * scale, (F.col(lat) - F.lag(lat).over(w)) * METRES_PER_DEGREE)

    a = matches.withColumns({"excess": hop("snap_lat", "snap_lon") - hop("dr_lat", "dr_lon"), "_dt": F.col(t_s) - F.lag(t_s).over(w)})
    return a.where((F.col("excess") > JUMP_M) & (F.col("_dt") < JUMP_S)).drop("_dt")


def matcher_summary(results: DataFrame, key: str) -> DataFrame:
    """Over rows (``e_dr, e_snap, matched``): how many are matched, mean and p90 error, percent of the matched that it helped."""
    return results.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("matched"), 1)).alias("matched"),
        F.avg("e_snap").alias("mean_error"),
        F.avg("e_dr").alias("mean_unaided"),
        F.percentile("e_snap", F.lit(0.9)).alias("p90_error"),
        (100 * F.avg(F.when(F.col("matched"), (F.col("e_snap") < F.col("e_dr")).cast("double")))).alias("helped"),
    )


def match_hops(results: DataFrame, key: str, order: str) -> DataFrame:
    """Pairs of matches that follow each other within 40 rows: ``key, seg_a, seg_b``."""
    w = by(key, order)
    m = results.where("matched").select(key, order, "seg", F.lag("seg").over(w).alias("seg_a"), (F.col(order) - F.lag(order).over(w)).alias("_gap"))
    return m.where(F.col("_gap") <= NEIGHBOURS).select(key, "seg_a", F.col("seg").alias("seg_b"))


def integrator_report(track: DataFrame, key: str) -> DataFrame:
    """Over samples (``accepted, still, speed, truth, step_m, true_m``): dropped, stand-still and false stand-still percent, distance ratio, shortfall.

    All but the first two look at accepted samples; a stand-still is false where the truth moves at more than 1 m/s.
    """
    ok = F.col("accepted")
    moving = ok & (F.col("truth") > MOVING)
    still = F.col("still").cast("double")
    made, real = F.sum(F.when(ok, F.col("step_m"))), F.sum("true_m")
    ratio = F.when(real > 0, made / real)
    return track.groupBy(key).agg(
        F.count("*").alias("samples"),
        (100 * F.avg(1 - ok.cast("double"))).alias("dropped"),
        (100 * F.avg(F.when(ok, still))).alias("zupt"),
        (100 * F.avg(F.when(moving, still))).alias("false_zupt"),
        F.avg(F.when(moving, F.col("speed"))).alias("speed"),
        F.avg(F.when(moving, F.col("truth"))).alias("true_speed"),
        ratio.alias("ratio"),
        (100 * (1 - ratio)).alias("shortfall"),
    )


def channel_attribution(track: DataFrame, key: str, sign: str) -> DataFrame:
    """Where speed and yaw go wrong, each in its own units: bias, RMSE, relative bias, r, and degrees of heading an hour."""
    e, w = F.col("model_speed") - F.col("speed"), F.col("model_yaw") - F.col("yaw")
    both, yaws = e.isNotNull(), w.isNotNull()
    return track.groupBy(key).agg(
        F.avg(e).alias("speed_bias"),
        metrics.rmse(e).alias("speed_rmse"),
        (100 * F.avg(e) / F.nullif(F.avg(F.when(both, F.col("speed"))), F.lit(0.0))).alias("speed_percent"),
        metrics.correlation("model_speed", "speed").alias("speed_r"),
        F.degrees(F.avg(w)).alias("yaw_bias"),
        F.degrees(metrics.rmse(w)).alias("yaw_rmse"),
        metrics.correlation("model_yaw", "yaw").alias("yaw_r"),
        (F.degrees(F.avg(F.when(yaws, F.col(sign) * w))) * 3600).alias("heading_per_hour"),
    )


def sweep(rows: DataFrame, configs: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates for every configuration: ``configs`` is a hand of rows, of which each gets all of ``rows``."""
    return rows.crossJoin(F.broadcast(configs)).groupBy(*configs.columns, *keys).agg(*(v.alias(k) for k, v in aggregates.items()))


def _end(track: DataFrame, key: str, order: str, prefix: str) -> DataFrame:
    last = F.max_by(F.struct("lat", "lon"), order)
    return track.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(key).agg(last.alias("e")).select(key, F.col("e.lat").alias(f"{prefix}_lat"), F.col("e.lon").alias(f"{prefix}_lon"))


def drift_totals(fixes: DataFrame, original: DataFrame, recomputed: DataFrame, matched: DataFrame, key: str, order: str) -> DataFrame:
    """Distance of each track's end from the last fix: ``original, new, matched, driven, improvement``.

    A matched track without points ends where the recomputed one does and has no drift of its own; improvement is the share
    of the original drift that is gone, 0 where there was none.
    """
    w = by(key, order)
    step = fixes.withColumns({f"{c}0": F.lag(c).over(w) for c in ("lat", "lon")})
    driven = step.groupBy(key).agg(F.coalesce(F.sum(F.expr(geo.haversine("lat0", "lon0", "lat", "lon"))), F.lit(0.0)).alias("driven"))
    out = _end(fixes, key, order, "fix").join(driven, key)
    for track, name in ((original, "original"), (recomputed, "new"), (matched, "matched")):
        out = out.join(_end(track, key, order, name), key, "left").withColumn(name, F.expr(geo.haversine(f"{name}_lat", f"{name}_lon", "fix_lat", "fix_lon")))
    gain = F.when(F.col("original") > 0, 100 * (F.col("original") - F.col("new")) / F.col("original")).otherwise(0.0)
    return out.select(key, "original", "new", "matched", "driven", gain.alias("improvement"))


def unaided_baseline(track: DataFrame, fixes: DataFrame, key: str, t: str) -> DataFrame:
    """RMSE of the integrator's speed against that of usable fixes while moving; null below 50 moving rows."""
    good = fixes.where((F.col("acc") <= USABLE_M) & F.col("speed").isNotNull()).select(key, t, F.col("speed").alias("truth"))
    a = align.interpolate(track.select(key, t, "speed"), good, key, t, "truth")
    moving = F.col("truth") > BASELINE_MOVING
    e = F.when(moving, F.col("speed") - F.col("truth"))
    return a.groupBy(key).agg(F.count(e).alias("n"), F.when(F.count(e) >= BASELINE_ROWS, metrics.rmse(e)).alias("rmse"))


def verdict(scores: DataFrame) -> DataFrame:
    """``fit``: a model that errs less than the constant and follows the truth (r above 0.5)."""
    return scores.withColumn("fit", F.coalesce((F.col("rmse") < F.col("constant_rmse")) & (F.col("r") > 0.5), F.lit(False)))


def admissible_outages(starts: DataFrame, fixes: DataFrame, key: str, t: str, seconds: float, min_speed: float) -> DataFrame:
    """``starts`` (key, t) of outages that can be scored: the first fix from there on is fast enough and not the last, and the outage ends within the session."""
    w = by(key, t)
    f = fixes.select(key, t, F.struct(F.col("speed").alias("s"), F.lead(t).over(w).isNotNull().alias("more")).alias("first"))
    end = fixes.groupBy(key).agg(F.max(t).alias("_end"))
    ahead = F.first("first", True).over(Window.partitionBy(key).orderBy(F.col(t), F.col("_start").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = starts.select(key, t, F.lit(1).alias("_start")).unionByName(f.withColumn("_start", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_a", ahead).where("_start = 1").join(end, key)
    return both.where((F.col("_a.s") >= min_speed) & F.col("_a.more") & (F.col(t) + seconds <= F.col("_end"))).select(key, t, F.col("_a.s").alias("speed"))


def hand_over(unaided_s: Column, displacement_m: Column) -> Column:
    """Whether the road takes over from the integrator: after 4 s unaided and 60 m."""
    return (unaided_s >= 4.0) & (displacement_m >= 60.0)


def geodesic_metres(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """WGS84 distance, in Arrow batches."""
    @F.pandas_udf("double")
    def metres(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(geo.geodesic(*(x.to_numpy(float) for x in (a, b, c, d))))

    return metres(lat1, lon1, lat2, lon2)


def tilt_frame(samples: DataFrame, key: str, axes: tuple[str, str, str]) -> DataFrame:
    """Level frame of each run from its median gravity: ``d0..d2`` down, ``e0..e2`` and ``f0..f2`` across it.

    The first axis across is the x axis made level, or the y axis where x is nearly upright.
    """
    m = samples.groupBy(key).agg(*(F.percentile(a, F.lit(0.5)).alias(f"m{i}") for i, a in enumerate(axes)))
    size = F.sqrt(sum(F.col(f"m{i}") * F.col(f"m{i}") for i in range(3)))
    m = m.select(key, *((F.col(f"m{i}") / F.nullif(size, F.lit(0.0))).alias(f"d{i}") for i in range(3)))
    x = F.abs("d0") < 0.9
    ref = [F.when(x, 1.0).otherwise(0.0), F.when(x, 0.0).otherwise(1.0), F.lit(0.0)]
    along = F.when(x, F.col("d0")).otherwise(F.col("d1"))
    m = m.select("*", *((ref[i] - along * F.col(f"d{i}")).alias(f"u{i}") for i in range(3)))
    n = F.sqrt(sum(F.col(f"u{i}") * F.col(f"u{i}") for i in range(3)))
    m = m.select(key, "d0", "d1", "d2", *((F.col(f"u{i}") / n).alias(f"e{i}") for i in range(3)))
    cross = [F.col(f"d{(i + 1) % 3}") * F.col(f"e{(i + 2) % 3}") - F.col(f"d{(i + 2) % 3}") * F.col(f"e{(i + 1) % 3}") for i in range(3)]
    return m.select("*", *(c.alias(f"f{i}") for i, c in enumerate(cross)))


def rival(states: DataFrame, keys: list[str], score: str, bearing: str, least: float = 30.0) -> DataFrame:
    """For each group the best state's score and that of the first one in order of score whose road runs more than 30 degrees otherwise."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "seg_id")
    a = states.withColumn("_b", F.first(bearing).over(w)).withColumn("_s", F.first(score).over(w))
    off = F.expr(geo.undirected_difference(bearing, "_b"))
    return a.groupBy(*keys).agg(F.first("_s").alias("best"), F.max(F.when(off > least, F.col(score))).alias("rival"))


def confidence(best: Column, other: Column) -> Column:
    """Share of the best of two log scores; 1 without a rival."""
    return F.when(other.isNull(), 1.0).otherwise(1 / (1 + F.exp(other - best)))
