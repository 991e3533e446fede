"""Satellite geometry and speed estimates from few satellites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.functions.geo import d

#: Radius of the orbits, inclination, planes and satellites in each, period.
ORBIT_M, INCLINATION, PLANES, EACH, PERIOD_S = 26_560_000.0, 55.0, 6, 4, 43_082.0


def constellation_sql(t: str = "t") -> dict[str, str]:
    """Position of satellite ``sat`` (0 to 23) at time ``t``, circular orbits."""
    plane, slot = "CAST(floor(sat / 4) AS DOUBLE)", "CAST(sat % 4 AS DOUBLE)"
    u = f"radians(({slot}) * 90 + ({plane}) * 15 + 360 * ({t}) / {d(PERIOD_S)})"
    node, i = f"radians(({plane}) * 60)", f"radians({d(INCLINATION)})"
    return {
        "sx": f"({d(ORBIT_M)} * (cos({u}) * cos({node}) - sin({u}) * cos({i}) * sin({node})))",
        "sy": f"({d(ORBIT_M)} * (cos({u}) * sin({node}) + sin({u}) * cos({i}) * cos({node})))",
        "sz": f"({d(ORBIT_M)} * sin({u}) * sin({i}))",
    }


def constellation(spark: SparkSession, times: DataFrame, t: str = "t") -> DataFrame:
    """Each time with all satellites; the satellites are a fixed list within the row, not a join."""
    a = times.withColumn("sat", F.explode(F.sequence(F.lit(0), F.lit(PLANES * EACH - 1))))
    return a.withColumns({k: F.expr(v) for k, v in constellation_sql(t).items()})


def line_of_sight_sql(lat: str, lon: str) -> dict[str, str]:
    """Unit vector to the satellite in east, north, up."""
    x, y, z = geo.ecef(lat, lon, "0")
    b = geo.enu_basis(lat, lon)
    v = (f"(sx - {x})", f"(sy - {y})", f"(sz - {z})")
    size = "sqrt(" + " + ".join(f"{p} * {p}" for p in v) + ")"
    return {f"l{a}": "((" + " + ".join(f"{b[a + k]} * {p}" for k, p in zip("xyz", v)) + f") / {size})" for a in "enu"}


def visible(sats: DataFrame, lat: str = "lat", lon: str = "lon", mask_deg: float = 15.0) -> DataFrame:
    out = sats.withColumns({k: F.expr(v) for k, v in line_of_sight_sql(lat, lon).items()})
    return out.withColumn("elevation", F.degrees(F.asin("lu"))).where(F.col("elevation") >= mask_deg)


def chosen(sats: DataFrame, epoch: list[str], order: str, n: int, place: str = "") -> DataFrame:
    """The first ``n`` satellites of each epoch: by ``elevation``, along the travel (``dot``) or by a hash (``random``); with their ``place`` if it has a name."""
    by = {"elevation": F.desc("elevation"), "dot": F.desc(F.abs("dot")), "random": F.xxhash64(*epoch, "sat")}[order]
    w = Window.partitionBy(*epoch).orderBy(by, "sat")
    out = sats.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return out.withColumnRenamed("_k", place) if place else out.drop("_k")


def solve(sats: DataFrame, epoch: list[str], mode: str) -> DataFrame:
    """Speed and its sigma for a unit of noise from range rates ``rate``, directions ``le, ln, lu`` and course (sin, cos in ``ue, un``).

    ``coast``: speed along the course, clock known; ``nhc``: with clock drift; ``flat``: two speeds and drift; ``full``: three.
    All are sums by epoch; the last two solve their normal equations for a batch of epochs at once, null where these are singular.
    """
    if mode == "coast":
        h = F.col("le") * F.col("ue") + F.col("ln") * F.col("un")
        return sats.groupBy(*epoch).agg((F.sum(h * F.col("rate")) / F.nullif(F.sum(h * h), F.lit(0.0))).alias("speed"), (1 / F.sqrt(F.nullif(F.sum(h * h), F.lit(0.0)))).alias("sigma"))
    if mode == "nhc":
        h = F.col("le") * F.col("ue") + F.col("ln") * F.col("un")
        n, s, ss, r, sr = F.count("*"), F.sum(h), F.sum(h * h), F.sum("rate"), F.sum(h * F.col("rate"))
        det = F.nullif(n * ss - s * s, F.lit(0.0))
        return sats.groupBy(*epoch).agg(((n * sr - s * r) / det).alias("speed"), F.sqrt(F.abs(n / det)).alias("sigma"))
    columns = ["le", "ln", "1"] if mode == "flat" else ["le", "ln", "lu", "1"]
    size = len(columns)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    x = [F.lit(1.0) if c == "1" else F.col(c) for c in columns]
    sums = sats.groupBy(*epoch).agg(*(F.sum(x[i] * x[j]).alias(f"_a{i}{j}") for i, j in upper), *(F.sum(x[i] * F.col("rate")).alias(f"_b{i}") for i in range(size)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            a, b = np.zeros((len(pdf), size, size)), pdf[[f"_b{i}" for i in range(size)]].to_numpy(float)
            for i, j in upper:
                a[:, i, j] = a[:, j, i] = pdf[f"_a{i}{j}"]
            least = np.linalg.eigvalsh(a)
            ok = least[:, 0] > 1e-10 * least[:, -1]
            inverse = np.linalg.inv(np.where(ok[:, None, None], a, np.eye(size)))
            v = np.einsum("nij,nj->ni", inverse, b)
            out = pdf[epoch].copy()
            out["speed"] = np.where(ok, np.hypot(v[:, 0], v[:, 1]), np.nan)
            out["sigma"] = np.where(ok, np.sqrt(inverse[:, 0, 0] + inverse[:, 1, 1]), np.nan)
            yield out

    kinds = dict(sats.dtypes)
    out = sums.mapInPandas(run, ", ".join(f"{e} {kinds[e]}" for e in epoch) + ", speed double, sigma double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("speed", "sigma")})


def accepted(estimates: DataFrame, most: float) -> DataFrame:
    """Estimates whose own sigma is within the gate: beyond it they are divisions by a small number."""
    return estimates.where(F.col("sigma") <= most)


#: Fixed values of the sweep: epochs of a track, noise of a range rate, of the clock's drift, of the course, gate of the sigma, elevation mask.
SWEEP = dict(epochs=40, rate=0.3, drift=1.0, course_deg=3.0, sigma=2.0, mask=15.0)
NEEDS = {"coast": 1, "nhc": 2, "flat": 3, "full": 4}


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed(h: np.ndarray, *values) -> np.ndarray:
    """Spark's ``xxhash64``, carried on from the hashes ``h`` over columns of 32-bit integers."""
    for v in values:
        h = (h + _P5 + np.uint64(4)) ^ (np.asarray(v).astype(np.uint64) * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h = h ^ (h >> np.uint64(32))
    return h


def _noise(h: np.ndarray, salt: int) -> np.ndarray:
    """A standard normal that hangs on the hashes of its keys alone."""
    u = lambda k: (_hashed(h, salt, k).view(np.int64) % 1_000_003 + 0.5) / 1_000_003.0
    return np.sqrt(-2 * np.log(u(1))) * np.cos(2 * np.pi * u(2))


def _sight(t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_of_sight_sql`` to the satellites of ``constellation_sql`` for arrays of epochs, a column for each satellite."""
    t, lat, lon = t[:, None], np.radians(lat)[:, None], np.radians(lon)[:, None]
    plane, slot = np.divmod(np.arange(PLANES * EACH), EACH)
    u, node, i = np.radians(slot * 90 + plane * 15 + 360 * t / PERIOD_S), np.radians(plane * 60), np.radians(INCLINATION)
    cu, su, cn, sn = np.cos(u), np.sin(u), np.cos(node), np.sin(node)
    sp, cp, sl, cl = np.sin(lat), np.cos(lat), np.sin(lon), np.cos(lon)
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    n = geo.WGS84_A / np.sqrt(1 - e2 * sp**2)
    x = ORBIT_M * (cu * cn - su * np.cos(i) * sn) - n * cp * cl
    y = ORBIT_M * (cu * sn + su * np.cos(i) * cn) - n * cp * sl
    z = ORBIT_M * su * np.sin(i) - n * (1 - e2) * sp
    size, ahead = np.sqrt(x * x + y * y + z * z), cl * x + sl * y
    return (cl * y - sl * x) / size, (cp * z - sp * ahead) / size, (cp * ahead + sp * z) / size


def _flat_speed(a: list[list[np.ndarray]], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Speed, its sigma and the determinant from normal equations with the two speeds first, for arrays of them: the other unknowns are eliminated."""
    a, b, det = [list(row) for row in a], list(b), 1.0
    for k in range(len(b) - 1, 1, -1):
        det = det * a[k][k]
        for i in range(k):
            f = a[i][k] / a[k][k]
            b[i] = b[i] - f * b[k]
            for j in range(i, k):
                a[i][j] = a[j][i] = a[i][j] - f * a[k][j]
    two = a[0][0] * a[1][1] - a[0][1] ** 2
    v = (a[1][1] * b[0] - a[0][1] * b[1]) / two, (a[0][0] * b[1] - a[0][1] * b[0]) / two
    return np.hypot(*v), np.sqrt((a[0][0] + a[1][1]) / two), det * two


def _estimates(x: np.ndarray, y: np.ndarray, z: np.ndarray, rate: np.ndarray, drift: np.ndarray, ue: np.ndarray, un: np.ndarray, most_sigma: float):
    """``n, mode, speed, good`` by each estimator of ``solve`` from the first satellites of the rows; good: within the gate, and not singular."""
    h = x * ue[:, None] + y * un[:, None]
    columns = [x, y, z, np.ones_like(x)]
    total = lambda v: np.cumsum(v, axis=1)
    s, ss, r, sr, known = total(h), total(h * h), total(rate), total(h * rate), total(h * (rate - drift[:, None]))
    a, b = [[total(p * q) for q in columns] for p in columns], [total(p * rate) for p in columns]
    for n in range(1, x.shape[1] + 1):
        k = n - 1
        yield n, "coast", (speed := known[:, k] / ss[:, k]), np.isfinite(speed) & (1 / np.sqrt(ss[:, k]) <= most_sigma)
        if n >= NEEDS["nhc"]:
            det = n * ss[:, k] - s[:, k] ** 2
            yield n, "nhc", (speed := (n * sr[:, k] - s[:, k] * r[:, k]) / det), np.isfinite(speed) & (np.sqrt(np.abs(n / det)) <= most_sigma)
        for mode, picked in (("flat", [0, 1, 3]), ("full", [0, 1, 2, 3])):
            if n >= NEEDS[mode]:
                m, size = [[a[i][j][:, k] for j in picked] for i in picked], len(picked)
                speed, sigma, det = _flat_speed(m, [b[i][:, k] for i in picked])
                good = np.isfinite(speed) & (sigma <= most_sigma)
                trace = sum(m[i][i] for i in range(size))
                # the least eigenvalue is det / (trace / (size - 1)) ** (size - 1) at least; where that is too small to tell, it is sought
                doubt = np.flatnonzero(good & ~(det > 2e-10 * trace * (trace / (size - 1)) ** (size - 1)))
                if doubt.size:
                    least = np.linalg.eigvalsh(np.array([[v[doubt] for v in row] for row in m]).transpose(2, 0, 1))
                    good[doubt] = least[:, 0] > 1e-10 * least[:, -1]
                yield n, mode, speed, good


def _swept(pdf: pd.DataFrame, c: dict, trials: int, most: int) -> Iterator[tuple]:
    """``strategy, mode, n, total, kept, sum of squared errors`` of each trial for a batch of epochs, of which ``key`` is the hash."""
    key = pdf["key"].to_numpy(np.int64).view(np.uint64)
    speed, bearing = pdf["speed"].to_numpy(float), pdf["bearing"].to_numpy(float)
    sight = _sight(*(pdf[k].to_numpy(float) for k in ("t_s", "lat", "lon")))
    elevation = np.degrees(np.arcsin(np.clip(sight[2], -1, 1)))
    seen = ~(elevation < c["mask"])
    count = seen.sum(axis=1)
    sat = np.argsort(~seen, axis=1, kind="stable")[:, : count.max(initial=0)]  # those in view, in their order
    seen, le, ln, lu, elevation = (np.take_along_axis(v, sat, 1) for v in (seen, *sight, elevation))
    dot = le * np.sin(np.radians(bearing))[:, None] + ln * np.cos(np.radians(bearing))[:, None]
    best = {"elevation": np.where(seen, -elevation, np.inf), "dot": np.where(seen, -np.abs(dot), np.inf)}
    for trial in range(trials):
        h = _hashed(key, trial)
        each = _hashed(h[:, None], sat)
        best["random"] = np.where(seen, each.view(np.int64), np.iinfo(np.int64).max)
        drift = c["drift"] * _noise(h, 1)
        rate = dot * speed[:, None] + drift[:, None] + c["rate"] * _noise(each, 2)
        course = np.radians(bearing + c["course_deg"] * _noise(h, 3))
        for strategy, order in best.items():
            first = np.argsort(order, axis=1, kind="stable")[:, :most]
            picked = (np.take_along_axis(v, first, 1) for v in (le, ln, lu, rate))
            for n, mode, got, good in _estimates(*picked, drift, np.sin(course), np.cos(course), c["sigma"] / c["rate"]):
                there, e = count >= n, got - speed
                e = e[there & good & np.isfinite(e)]
                yield strategy, mode, n, int(there.sum()), len(e), float(e @ e)


def sweep(epochs: DataFrame, trials: int = 2, most: int = 4) -> DataFrame:
    """``strategy, mode, n, total, kept, rmse``: errors of the speed by strategy of choice, estimator and number of satellites.

    Of a track (``session``, rows numbered by ``seq``) about forty epochs are taken, evenly spread, and all of a shorter one.
    Noise hangs on the epoch, satellite and trial, so a sweep can be repeated. An estimate whose sigma is beyond the gate,
    or that is no number, counts in ``total`` alone. Epochs without a session, time or place are left out.

    The choice and the estimates of ``visible``, ``chosen`` and ``solve``, for a batch of epochs at once: an epoch needs no
    other, so past the count of a track's rows only the sums of each task are shuffled.
    """
    c = dict(SWEEP)
    every = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("session")) / c["epochs"]))
    epochs = epochs.withColumn("_every", every).where("seq % _every = 0 AND session IS NOT NULL AND t_s IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    epochs = epochs.select(F.xxhash64("session", "seq").alias("key"), *(F.col(k).cast("double").alias(k) for k in ("t_s", "lat", "lon", "speed", "bearing")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        with np.errstate(all="ignore"):
            for pdf in parts:
                for *cell, total, kept, square in _swept(pdf, c, trials, most):
                    s = sums.setdefault(tuple(cell), [0, 0, 0.0])
                    s[0], s[1], s[2] = s[0] + total, s[1] + kept, s[2] + square
        yield pd.DataFrame([(*cell, *s) for cell, s in sums.items() if s[0]], columns=["strategy", "mode", "n", "total", "kept", "square"])

    sums = epochs.mapInPandas(run, "strategy string, mode string, n int, total long, kept long, square double")
    total, kept = F.sum("total"), F.sum("kept")
    return sums.groupBy("strategy", "mode", "n").agg(total.alias("total"), kept.alias("kept"), F.sqrt(F.sum("square") / F.nullif(kept, F.lit(0))).alias("rmse"))
