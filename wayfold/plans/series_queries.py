"""Queries of alignment, sequence, aggregate, spatial and set operators over derived relations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.functions.geo import d
from wayfold.operators import align, metrics, spatial, windows
from wayfold.plans.fixtures import oracle, relation

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def fix(spark, sf):
    return relation(spark, sf, "d_fix")


def pred(spark, sf):
    return relation(spark, sf, "d_pred")


def r(x, places=6):
    return F.round(F.col(x) if isinstance(x, str) else x, places) + 0


FIX, PRED, SEG, IMU = (f"({oracle(n)})" for n in ("d_fix", "d_pred", "d_seg", "d_imu"))
W = "OVER (PARTITION BY session ORDER BY seq)"
SAMPLES = f"(SELECT session, t_s, speed AS v FROM {FIX} WHERE seq % 3 = 0 AND speed IS NOT NULL)"
GRID = f"(SELECT session, seq, t_s + CAST(0.5 AS DOUBLE) AS t_s FROM {FIX})"
ASOF = f"""SELECT g.session, g.seq, g.t_s, p.t_s AS pt, p.v AS pv, n.t_s AS nt, n.v AS nv, c.n FROM {GRID} g ASOF LEFT JOIN {SAMPLES} p ON g.session = p.session AND g.t_s >= p.t_s
 ASOF LEFT JOIN {SAMPLES} n ON g.session = n.session AND g.t_s <= n.t_s LEFT JOIN (SELECT session, count(*) AS n FROM {SAMPLES} GROUP BY 1) c ON c.session = g.session"""
LERP = "CASE WHEN n IS NULL OR n < 2 THEN NULL WHEN pt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN nt = pt THEN pv ELSE pv + (nv - pv) * (t_s - pt) / (nt - pt) END ELSE {} END"


def sides(spark, sf):
    f = fix(spark, sf)
    grid = f.select("session", "seq", (F.col("t_s") + 0.5).alias("t_s"))
    return grid, f.where("seq % 3 = 0").select("session", "t_s", F.col("speed").alias("v"))


@query(f"SELECT session, seq, round({LERP.format('coalesce(pv, nv)')}, 6) AS v FROM ({ASOF})")
def jn_01_interpolate(spark, sf):
    return align.interpolate(*sides(spark, sf), "session", "t_s", "v").select("session", "seq", r("v").alias("v"))


@query(f"SELECT session, seq, round({LERP.format('NULL')}, 6) AS v FROM ({ASOF})")
def jn_02_interpolate_inside(spark, sf):
    return align.interpolate(*sides(spark, sf), "session", "t_s", "v", inside_only=True).select("session", "seq", r("v").alias("v"))


@query(f"SELECT session, seq, round(least(t_s - pt, nt - t_s), 6) AS gap FROM ({ASOF})")
def jn_03_nearest_gap(spark, sf):
    return align.nearest_gap(*sides(spark, sf), "session", "t_s", "v").select("session", "seq", r("gap").alias("gap"))


@query(f"SELECT session, seq, pv AS v FROM ({ASOF})")
def jn_04_latest(spark, sf):
    return align.latest(*sides(spark, sf), "session", "t_s", "v").select("session", "seq", "v")


@query(f"SELECT session, seq, nv AS v FROM ({ASOF})")
def jn_05_following(spark, sf):
    return align.following(*sides(spark, sf), "session", "t_s", "v").select("session", "seq", "v")


@query(f"""WITH b AS (SELECT session, sensor, CAST(floor(t_ns / 300000000) AS BIGINT) AS bucket, avg(v0) AS v0, avg(v2) AS v2 FROM {IMU} WHERE sensor <> 'rv' GROUP BY 1, 2, 3)
SELECT a.session, a.bucket, round(a.v0, 6) AS ax, round(g.v2, 6) AS gz FROM b a JOIN b g ON a.session = g.session AND a.bucket = g.bucket AND a.sensor = 'accel' AND g.sensor = 'gyro'""")
def jn_06_bucket_join(spark, sf):
    b = align.bucket_means(relation(spark, sf, "d_imu").where("sensor <> 'rv'"), ["session", "sensor"], "t_ns", ["v0", "v2"], 300_000_000)
    a, g = (b.where(F.col("sensor") == s).select("session", "bucket", r(v).alias(n)) for s, v, n in (("accel", "v0", "ax"), ("gyro", "v2", "gz")))
    return align.bucket_join(a, g, ["session"])


@query(f"SELECT session, i, round(t0 + i * CAST(2.5 AS DOUBLE), 6) AS t_s FROM (SELECT session, t0, unnest(range(0, CAST(floor((t1 - t0) / 2.5 + 0.000000001) AS BIGINT) + 1)) AS i FROM (SELECT session, min(t_s) AS t0, max(t_s) AS t1 FROM {FIX} GROUP BY 1))")
def jn_07_uniform_grid(spark, sf):
    return align.uniform_grid(fix(spark, sf), "session", "t_s", 2.5).select("session", "i", r("t_s").alias("t_s"))


@query(f"SELECT a.session, a.seq, a.speed, b.acc FROM {FIX} a JOIN {FIX} b ON a.session = b.session AND a.seq = b.seq WHERE b.seq < 20 + b.session % 50")
def jn_08_zip(spark, sf):
    f = fix(spark, sf)
    return align.zipped(f.select("session", "seq", "speed"), f.where("seq < 20 + session % 50").select("session", "seq", "acc"), "session", "seq")  # the right side is the shorter one in most sessions


@query(f"SELECT a.session, a.seq, a.speed, b.acc FROM {FIX} a JOIN {FIX} b ON a.session = b.session AND a.seq = b.seq + 4")
def jn_09_lag_zip(spark, sf):
    f = fix(spark, sf)
    return align.zipped(f.select("session", "seq", "speed"), f.select("session", "seq", "acc"), "session", "seq", 4)


@query(f"SELECT f.session, f.seq, a.m FROM {FIX} f LEFT JOIN (SELECT session, avg(acc) AS m FROM {FIX} GROUP BY 1 HAVING count(*) > 70) a USING (session)")
def jn_16_lookup(spark, sf):
    f = fix(spark, sf)
    return f.select("session", "seq").join(f.groupBy("session").agg(F.avg("acc").alias("m"), F.count("*").alias("n")).where("n > 70").drop("n"), "session", "left")


@query(f"SELECT session, seq FROM {FIX} WHERE session IN (SELECT session FROM {FIX} GROUP BY 1 HAVING count(*) > 70)")
def jn_17_semi(spark, sf):
    f = fix(spark, sf)
    return f.select("session", "seq").join(f.groupBy("session").count().where("count > 70"), "session", "left_semi")


@query(f"SELECT session, seq FROM {FIX} WHERE session NOT IN (SELECT session FROM {FIX} GROUP BY 1 HAVING count(*) > 70)")
def jn_18_anti(spark, sf):
    f = fix(spark, sf)
    return f.select("session", "seq").join(f.groupBy("session").count().where("count > 70"), "session", "left_anti")


@query(f"SELECT session, seq, coalesce(lead(rn) OVER (PARTITION BY session ORDER BY seq), -1) AS next FROM (SELECT session, seq, row_number() OVER (ORDER BY session, seq) - 1 AS rn FROM {FIX})")
def jn_19_next_in_run(spark, sf):
    f = fix(spark, sf).select("session", "seq")
    # a dense number over all rows without one task sorting them: sizes of the runs before, and the place within
    sizes = f.groupBy("session").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.orderBy("session")) - F.col("n"))
    w = windows.by("session", "seq")
    a = f.join(before, "session").withColumn("rn", F.col("base") + F.row_number().over(w) - 1)
    return a.select("session", "seq", F.coalesce(F.lead("rn").over(w), F.lit(-1)).cast("long").alias("next"))


def _cand_sql() -> str:
    t = geo.segment_fraction("lat", "lon", "alat", "alon", "blat", "blon")
    dist = geo.local_metres("lat", "lon", geo.along("alat", "blat", "t"), geo.along("alon", "blon", "t"))
    return f"""SELECT * FROM (SELECT session, seq, seg_id, dist, bearing, row_number() OVER (PARTITION BY session, seq ORDER BY dist, seg_id) AS rank, alat, alon, blat, blon
 FROM (SELECT *, {dist} AS dist FROM (SELECT p.*, s.*, {t} AS t FROM (SELECT session, seq, lat, lon, bearing FROM {FIX}) p JOIN {SEG} s ON abs(s.alat - p.lat) < 0.01 AND abs(s.alon - p.lon) < 0.01) WHERE t IS NOT NULL) WHERE dist <= 150) WHERE rank <= 24"""


@query(f"SELECT session, seq, seg_id, round(dist, 4) AS dist, CAST(rank AS BIGINT) AS rank FROM ({_cand_sql()})")
def jn_10_srt_01_candidates(spark, sf):
    c = spatial.candidates(fix(spark, sf), relation(spark, sf, "d_seg"), ["session", "seq"], 150.0)
    return c.select("session", "seq", "seg_id", r("dist", 4).alias("dist"), F.col("rank").cast("long").alias("rank"))


_BEAR = geo.bearing("alat", "alon", "blat", "blon")
_COST = f"dist + {d(0.5)} * abs({geo.bearing_difference('bearing', geo.segment_heading('sb', 'dir'))})"


@query(f"""SELECT session, seq, seg_id, dir, round(cost, 4) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY cost, seg_id, dir DESC) AS k FROM
 (SELECT *, {_COST} AS cost FROM (SELECT c.*, {_BEAR} AS sb, dir FROM ({_cand_sql()}) c, (SELECT 1 AS dir UNION ALL SELECT -1) dd))) WHERE k = 1""")
def jn_12_nearest_state(spark, sf):
    best = spatial.nearest_state(fix(spark, sf), relation(spark, sf, "d_seg"), ["session", "seq"], 150.0)
    return best.select("session", "seq", "seg_id", "dir", r("cost", 4).alias("cost"))


_NODES = f"(SELECT seg_id, 0 AS side, {spatial.node_key('alat', 'alon')} AS node FROM {SEG} UNION ALL SELECT seg_id, 1, {spatial.node_key('blat', 'blon')} FROM {SEG})"


@query(f"SELECT degree, count(*) AS nodes FROM (SELECT node, count(*) AS degree FROM {_NODES} GROUP BY 1) GROUP BY 1")
def jn_13_topology_degrees(spark, sf):
    return spatial.topology(relation(spark, sf, "d_seg")).groupBy("node").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(f"""WITH e AS (SELECT n.seg_id, side, node, b FROM {_NODES} n JOIN (SELECT seg_id, {_BEAR} AS b FROM {SEG}) s ON s.seg_id = n.seg_id)
SELECT o.seg_id, CASE WHEN o.side = 1 THEN 1 ELSE -1 END AS direction, i.seg_id AS next_id, CASE WHEN i.side = 0 THEN 1 ELSE -1 END AS next_direction,
 round(abs({geo.bearing_difference(geo.segment_heading('i.b', 'CASE WHEN i.side = 0 THEN 1 ELSE -1 END'), geo.segment_heading('o.b', 'CASE WHEN o.side = 1 THEN 1 ELSE -1 END'))}), 3) AS turn FROM e o JOIN e i ON o.node = i.node AND o.seg_id <> i.seg_id""")
def gr_02_successors(spark, sf):
    return spatial.successors(relation(spark, sf, "d_seg")).withColumn("turn", r("turn", 3))


@query(f"SELECT count(DISTINCT node) AS nodes, round(avg(CASE WHEN c > 1 THEN 1.0 ELSE 0 END), 6) AS linked, round(avg(CAST(c AS DOUBLE)), 6) AS degree FROM (SELECT node, count(*) AS c FROM {_NODES} GROUP BY 1)")
def agg_31_graph_statistics(spark, sf):
    n = spatial.topology(relation(spark, sf, "d_seg")).groupBy("node").agg(F.count("*").alias("c"))
    return n.agg(F.count("*").alias("nodes"), r(F.avg(F.when(F.col("c") > 1, 1.0).otherwise(0.0))).alias("linked"), r(F.avg(F.col("c").cast("double"))).alias("degree"))


# sequence operators

@query(f"SELECT session, seq, speed - lag(speed) {W} AS step FROM {FIX}")
def win_01_step(spark, sf):
    return fix(spark, sf).select("session", "seq", windows.step("speed", windows.by("session", "seq")).alias("step"))


@query(f"""SELECT session, seq, round(CASE WHEN h IS NULL THEN (f2 - f1) / k WHEN k IS NULL THEN (f1 - f0) / h ELSE (h * h * f2 + (k * k - h * h) * f1 - k * k * f0) / (h * k * (h + k)) END, 6) AS g FROM
 (SELECT session, seq, lag(speed) {W} AS f0, speed AS f1, lead(speed) {W} AS f2, t_s - lag(t_s) {W} AS h, lead(t_s) {W} - t_s AS k FROM {FIX})""")
def win_02_gradient(spark, sf):
    return fix(spark, sf).select("session", "seq", r(windows.gradient("speed", "t_s", windows.by("session", "seq"))).alias("g"))


@query(f"""SELECT session, seq, round(f + sum(dd) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS u FROM (SELECT session, seq, first_value(bearing) {W} AS f,
 coalesce(((bearing - lag(bearing) {W} + 180) % 360 + 360) % 360 - 180, 0) AS dd FROM {FIX})""")
def win_03_unwrap(spark, sf):
    return windows.unwrapped(fix(spark, sf), "bearing", windows.by("session", "seq"), "u").select("session", "seq", r("u", 4).alias("u"))


@query(f"SELECT session, seq, round(sum(speed) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS s FROM {FIX}")
def win_04_running(spark, sf):
    return fix(spark, sf).select("session", "seq", r(windows.running("speed", windows.by("session", "seq")), 4).alias("s"))


@query(f"SELECT session, seq, round(sum(speed) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15, 6) AS m FROM {FIX}")
def win_05_moving_average(spark, sf):
    return fix(spark, sf).select("session", "seq", r(windows.moving_average("speed", 15, windows.by("session", "seq"))).alias("m"))


@query(f"""SELECT a.session, a.seq AS start, a.seq + 9 AS "end", round(avg(b.speed), 6) AS mean, a.seq + 10 AS label_index FROM {FIX} a JOIN {FIX} b ON a.session = b.session AND b.seq BETWEEN a.seq AND a.seq + 9
 JOIN (SELECT session, count(*) AS n FROM {FIX} GROUP BY 1) c ON c.session = a.session WHERE a.seq % 5 = 0 AND a.seq <= n - 11 GROUP BY a.session, a.seq""")
def win_06_sliding(spark, sf):
    s = windows.sliding(fix(spark, sf), "session", "seq", "speed", 10, 5, label_after=True)
    mean = F.aggregate("window", F.lit(0.0), lambda t, x: t + x) / F.size("window")
    return s.select("session", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), r(mean).alias("mean"), F.col("label_index").cast("long").alias("label_index"))


@query(f"SELECT session, seq, round(avg(speed) OVER (PARTITION BY session ORDER BY seq ROWS 9 PRECEDING), 6) AS m FROM {FIX} QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq) > 10")
def win_07_ring_buffer(spark, sf):
    w = windows.by("session", "seq")
    return fix(spark, sf).withColumns({"m": r(F.avg("speed").over(w.rowsBetween(-9, 0))), "k": F.row_number().over(w)}).where("k > 10").select("session", "seq", "m")


@query(f"SELECT session, seq, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM (SELECT session, seq, CASE WHEN seq % 10 = 9 THEN speed END AS v FROM {FIX})")
def win_08_hold(spark, sf):
    w = windows.by("session", "seq")
    a = fix(spark, sf).withColumn("v", F.when(F.col("seq") % 10 == 9, F.col("speed")))
    return a.select("session", "seq", F.coalesce(F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("v"))


@query(f"""SELECT session, CAST(run AS BIGINT) AS run, count(*) AS n, min(t_s) AS t0, max(t_s) AS t1 FROM (SELECT *, sum(CASE WHEN p IS NOT NULL AND (t_s - p <= 0 OR t_s - p > 1) THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, lag(t_s) {W} AS p FROM {FIX})) GROUP BY 1, 2 HAVING count(*) >= 10""")
def win_09_clock_runs(spark, sf):
    return windows.clock_runs(fix(spark, sf), "session", "seq", "t_s", 1.0, 10)


@query(f"""SELECT session, quality, greatest(min(seq) - 1, 0) AS first, max(seq) AS last FROM (SELECT *, sum(CASE WHEN quality IS DISTINCT FROM pq THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k
 FROM (SELECT *, lag(quality) {W} AS pq FROM (SELECT session, seq, CASE WHEN acc > 30 THEN 'LOST' WHEN acc > 20 THEN 'WEAK' ELSE 'GOOD' END AS quality FROM {FIX}))) WHERE quality <> 'GOOD' GROUP BY session, quality, k""")
def win_10_quality_segments(spark, sf):
    a = fix(spark, sf).withColumn("quality", F.when(F.col("acc") > 30, "LOST").when(F.col("acc") > 20, "WEAK").otherwise("GOOD"))
    a = windows.islands(a, "session", "seq", ~F.col("quality").eqNullSafe(F.lag("quality").over(windows.by("session", "seq"))), "k").where("quality <> 'GOOD'")
    return a.groupBy("session", "quality", "k").agg(F.greatest(F.min("seq") - 1, F.lit(0)).alias("first"), F.max("seq").alias("last")).drop("k")


@query(f"""WITH a AS (SELECT session, seq, speed > 5 AS h, coalesce(t_s - lag(t_s) {W}, 0) AS dt FROM {FIX}),
b AS (SELECT *, sum(CASE WHEN NOT h THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT session, seq, CASE WHEN h THEN sum(CASE WHEN h THEN dt ELSE 0 END) OVER (PARTITION BY session, k ORDER BY seq ROWS UNBOUNDED PRECEDING) ELSE 0 END AS held FROM b""")
def win_11_held_time(spark, sf):
    return windows.held_time(fix(spark, sf), "session", "seq", "t_s", F.col("speed") > 5).select("session", "seq", "held")


@query(f"""WITH RECURSIVE f AS (SELECT session, seq, t_s FROM {FIX}), e AS (SELECT session, min(t_s) AS t_s FROM f GROUP BY 1 UNION ALL
 SELECT e.session, (SELECT min(f.t_s) FROM f WHERE f.session = e.session AND f.t_s >= e.t_s + 4) FROM e WHERE EXISTS (SELECT 1 FROM f WHERE f.session = e.session AND f.t_s >= e.t_s + 4)) SELECT session, t_s FROM e""")
def win_12_throttle(spark, sf):
    return windows.throttled(fix(spark, sf).select("session", "t_s"), "session", "t_s", 4.0)


@query(f"SELECT session, k, t0 + k * 15 AS start, t0 + k * 15 + 30 AS \"end\" FROM (SELECT session, t0, unnest(range(0, CAST(floor((t1 - t0 - 30) / 15) AS BIGINT) + 1)) AS k FROM (SELECT session, min(t_s) AS t0, max(t_s) AS t1 FROM {FIX} GROUP BY 1) WHERE t1 - t0 >= 30)")
def win_13_tiles(spark, sf):
    span = fix(spark, sf).groupBy("session").agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1"))
    return windows.tiles(span, "session", "t0", "t1", 30.0, 15.0).withColumn("k", F.col("k").cast("long"))


@query(f"SELECT session, seq, round(lat - first_value(lat) {W}, 8) AS dlat FROM {FIX}")
def win_14_rebase(spark, sf):
    return fix(spark, sf).select("session", "seq", r(F.col("lat") - F.first("lat").over(windows.by("session", "seq")), 8).alias("dlat"))


@query(f"SELECT session, seq, CASE WHEN count(speed) OVER w >= 12 THEN round(avg(speed) OVER w, 6) END AS mean FROM {FIX} WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)")
def win_15_trailing_calibration(spark, sf):
    w = windows.by("session", "seq").rowsBetween(-24, -1)
    return fix(spark, sf).select("session", "seq", F.when(F.count("speed").over(w) >= 12, r(F.avg("speed").over(w))).alias("mean"))


@query(f"SELECT session, sign, round(rms, 6) AS rms FROM (SELECT session, s AS sign, sqrt(avg(power(s * (bearing - 180) - speed * 10, 2))) AS rms FROM {FIX}, (SELECT 1 AS s UNION ALL SELECT -1) x GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session ORDER BY rms, sign DESC) = 1")
def win_16_best_sign(spark, sf):
    a = fix(spark, sf).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).groupBy("session", "sign").agg(metrics.rmse(F.col("sign") * (F.col("bearing") - 180) - F.col("speed") * 10).alias("rms"))
    return a.groupBy("session").agg(F.min(F.struct("rms", (-F.col("sign")).alias("n"))).alias("b")).select("session", (-F.col("b.n")).alias("sign"), r("b.rms").alias("rms"))


_LAGGED = f"(SELECT session, seq, lat, lon, coalesce(lag(lat, 10) {W}, first_value(lat) {W}) AS lat0, coalesce(lag(lon, 10) {W}, first_value(lon) {W}) AS lon0 FROM {FIX})"
_COURSE = f"CASE WHEN {geo.local_metres('lat0', 'lon0', 'lat', 'lon')} > 1 THEN round({geo.bearing('lat0', 'lon0', 'lat', 'lon')}, 4) END"


@query(f"SELECT session, seq, {_COURSE} AS course FROM {_LAGGED}")
def win_18_course(spark, sf):
    w = windows.by("session", "seq")
    a = fix(spark, sf).withColumns({f"{c}0": F.coalesce(F.lag(c, 10).over(w), F.first(c).over(w)) for c in ("lat", "lon")})
    return a.select("session", "seq", F.expr(_COURSE).alias("course"))


@query(f"SELECT session, round(avg(abs(ds)), 6) AS smoothness FROM (SELECT session, t_s - lag(t_s) {W} AS dt, speed - lag(speed) {W} AS ds FROM {FIX}) WHERE dt > 0 AND dt <= 1.5 GROUP BY 1")
def win_21_successive_difference(spark, sf):
    w = windows.by("session", "seq")
    a = fix(spark, sf).select("session", windows.step("t_s", w).alias("dt"), windows.step("speed", w).alias("ds")).where("dt > 0 AND dt <= 1.5D")
    return a.groupBy("session").agg(r(F.avg(F.abs("ds"))).alias("smoothness"))


_SEED = f"(SELECT session, seq, lat, lon, speed, lead(lat) {W} AS lat1, lead(lon) {W} AS lon1 FROM {FIX})"
_SB = f"radians({geo.bearing('lat', 'lon', 'lat1', 'lon1')})"


@query(f"SELECT session, seq, round(coalesce(speed * sin({_SB}), 0), 5) AS ve, round(coalesce(speed * cos({_SB}), 0), 5) AS vn FROM {_SEED}")
def win_23_velocity_seed(spark, sf):
    w = windows.by("session", "seq")
    a = fix(spark, sf).withColumns({f"{c}1": F.lead(c).over(w) for c in ("lat", "lon")})
    return a.select("session", "seq", *(r(F.coalesce(F.expr(f"speed * {f}({_SB})"), F.lit(0.0)), 5).alias(n) for f, n in (("sin", "ve"), ("cos", "vn"))))


# filters that look at other rows

@query(f"SELECT session, seq FROM (SELECT session, seq, t_s - lag(t_s) {W} AS dt FROM {FIX}) WHERE dt > 0 AND dt <= 2")
def flt_05_step_gate(spark, sf):
    return fix(spark, sf).withColumn("dt", windows.step("t_s", windows.by("session", "seq"))).where("dt > 0 AND dt <= 2").select("session", "seq")


@query(f"SELECT f.session, f.seq FROM {FIX} f JOIN (SELECT session, count(*) FILTER (speed > 12) AS m, min(seq) FILTER (speed > 12) AS a, max(seq) FILTER (speed > 12) AS b FROM {FIX} GROUP BY 1) s USING (session) WHERE m <= 2 OR seq BETWEEN a AND b")
def flt_07_driving_span(spark, sf):
    f = fix(spark, sf)
    m = F.when(F.col("speed") > 12, F.col("seq"))
    return f.join(f.groupBy("session").agg(F.count(m).alias("m"), F.min(m).alias("a"), F.max(m).alias("b")), "session").where("m <= 2 OR seq BETWEEN a AND b").select("session", "seq")


@query(f"SELECT session, seq, CASE WHEN least(coalesce(t_s - pt, 1e9), coalesce(nt - t_s, 1e9)) <= 1 THEN t_s END AS truth FROM ({ASOF})")
def flt_08_gap_mask(spark, sf):
    return align.nearest_gap(*sides(spark, sf), "session", "t_s", "v").select("session", "seq", F.when(F.coalesce("gap", F.lit(1e9)) <= 1, F.col("t_s")).alias("truth"))


@query(f"SELECT session, seq FROM {FIX} f JOIN (SELECT session, min(t_s) AS t0 FROM {FIX} GROUP BY 1) s USING (session) WHERE t_s - t0 >= 15")
def flt_19_start_discard(spark, sf):
    return fix(spark, sf).withColumn("t0", F.min("t_s").over(Window.partitionBy("session"))).where("t_s - t0 >= 15").select("session", "seq")


# aggregates

_E = "(pred - truth)"


@query(f"SELECT run, round(sqrt(avg({_E} * {_E})), 5) AS rmse, round(avg({_E}), 5) AS bias, round(avg(abs({_E})), 5) AS mae FROM {PRED} GROUP BY 1")
def agg_01_errors(spark, sf):
    e = F.col("pred") - F.col("truth")
    return pred(spark, sf).groupBy("run").agg(r(metrics.rmse(e), 5).alias("rmse"), r(metrics.bias(e), 5).alias("bias"), r(metrics.mae(e), 5).alias("mae"))


@query(f"SELECT run, CASE WHEN stddev_pop(pred) > 1e-9 THEN round(corr(pred, truth), 5) END AS r, round(stddev_pop(truth), 5) AS constant_rmse, round(stddev_pop(pred) / nullif(stddev_pop(truth), 0), 5) AS shrinkage FROM {PRED} GROUP BY 1")
def agg_02_03_04_correlation(spark, sf):
    return pred(spark, sf).groupBy("run").agg(r(metrics.pearson("pred", "truth"), 5).alias("r"), r(F.stddev_pop("truth"), 5).alias("constant_rmse"), r(metrics.spread_ratio("pred", "truth"), 5).alias("shrinkage"))


@query(f"SELECT run, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN sqrt(avg({_E} * {_E})) END, 5) AS rmse, round(CASE WHEN count(*) >= 10 THEN min(pred) END, 5) AS least, round(CASE WHEN count(*) >= 10 THEN max(pred) END, 5) AS most FROM {PRED} GROUP BY 1")
def agg_05_score(spark, sf):
    s = metrics.score("pred", "truth")
    return pred(spark, sf).groupBy("run").agg(s["n"].alias("n"), *(r(s[k], 5).alias(k) for k in ("rmse", "least", "most")))


@query(f"SELECT session, max_by(e, seq) AS crse, round(sum(e), 4) AS cae, round(avg(abs(e)), 5) AS aeps, count(e) AS seconds FROM (SELECT session, seq, speed - 7 AS e FROM {FIX}) GROUP BY 1")
def agg_06_07_08_33_outage(spark, sf):
    m = metrics.outage("e", "seq")
    return fix(spark, sf).withColumn("e", F.col("speed") - 7).groupBy("session").agg(m["crse"].alias("crse"), r(m["cae"], 4).alias("cae"), r(m["aeps"], 5).alias("aeps"), m["seconds"].alias("seconds"))


@query(f"""SELECT gate, round(avg(crse), 5) AS mean_crse, round(quantile_cont(crse, 0.5), 5) AS median_crse, round(abs(avg(cae)) / avg(crse), 5) AS bias_share FROM (SELECT session % 3 AS gate, session, max_by(abs(e), seq) AS crse, sum(e) AS cae FROM (SELECT session, seq, speed - 7 AS e FROM {FIX}) GROUP BY 1, 2) GROUP BY 1""")
def agg_09_outage_rollup(spark, sf):
    one = fix(spark, sf).withColumn("e", F.col("speed") - 7).groupBy((F.col("session") % 3).alias("gate"), "session").agg(F.max_by(F.abs("e"), "seq").alias("crse"), F.sum("e").alias("cae"))
    return one.groupBy("gate").agg(r(F.avg("crse"), 5).alias("mean_crse"), r(F.percentile("crse", F.lit(0.5)), 5).alias("median_crse"), r(F.abs(F.avg("cae")) / F.avg("crse"), 5).alias("bias_share"))


@query(f"SELECT session, max_by(acc, seq) AS final, max(acc) AS most, round(avg(acc), 6) AS mean, round(CASE WHEN max(seq) > 1 THEN 100 * max_by(acc, seq) / max(seq) ELSE 0 END, 5) AS percent FROM {FIX} GROUP BY 1")
def agg_10_drift(spark, sf):
    m = metrics.drift("acc", "seq", "seq")
    return fix(spark, sf).groupBy("session").agg(m["final"].alias("final"), m["most"].alias("most"), r(m["mean"]).alias("mean"), r(m["percent"], 5).alias("percent"))


@query(f"SELECT run, round(quantile_cont({_E}, 0.5), 6) AS median, round(quantile_cont({_E}, 0.9), 6) AS p90 FROM {PRED} GROUP BY 1")
def agg_11_percentiles(spark, sf):
    e = F.col("pred") - F.col("truth")
    return pred(spark, sf).groupBy("run").agg(r(F.percentile(e, F.lit(0.5))).alias("median"), r(F.percentile(e, F.lit(0.9))).alias("p90"))


def _path(df: DataFrame) -> DataFrame:
    w = windows.by("session", "seq")
    a = df.withColumns({f"{c}0": F.lag(c).over(w) for c in ("lat", "lon")})
    return a.groupBy("session").agg(r(F.coalesce(F.sum(F.expr(geo.haversine("lat0", "lon0", "lat", "lon"))), F.lit(0.0)), 4).alias("metres"))


def _path_sql(rows: str) -> str:
    return f"SELECT session, round(coalesce(sum({geo.haversine('lat0', 'lon0', 'lat', 'lon')}), 0), 4) AS metres FROM (SELECT session, lat, lon, lag(lat) {W} AS lat0, lag(lon) {W} AS lon0 FROM {rows}) GROUP BY 1"


@query(_path_sql(FIX))
def agg_14_path_length(spark, sf):
    return _path(fix(spark, sf))


@query(_path_sql(f"(SELECT * FROM {FIX} WHERE seq = 0 OR speed > 1)"))
def agg_15_live_distance(spark, sf):
    return _path(fix(spark, sf).where("seq = 0 OR speed > 1"))


@query(f"SELECT session, seq - seq % 8 AS epoch, count(*) AS visible, count(*) FILTER (used > 3) AS used, round(coalesce(avg(acc) FILTER (used > 3), 0), 6) AS mean_cn0, max(acc) AS most_cn0 FROM {FIX} GROUP BY 1, 2")
def agg_16_constellation(spark, sf):
    u = F.col("used") > 3
    return fix(spark, sf).groupBy("session", (F.col("seq") - F.col("seq") % 8).alias("epoch")).agg(F.count("*").alias("visible"), F.count(F.when(u, 1)).alias("used"), r(F.coalesce(F.avg(F.when(u, F.col("acc"))), F.lit(0.0))).alias("mean_cn0"), F.max("acc").alias("most_cn0"))


@query(f"SELECT session, round(degrees(atan2(avg(sin(radians(bearing))), avg(cos(radians(bearing))))), 4) AS mean FROM {FIX} GROUP BY 1")
def agg_17_circular_mean(spark, sf):
    return fix(spark, sf).groupBy("session").agg(r(metrics.circular_mean("bearing"), 4).alias("mean"))


@query(f"SELECT session, round(min(lat) - greatest((max(lat) - min(lat)) * 0.05, 0.001), 7) AS south, round(max(lat) + greatest((max(lat) - min(lat)) * 0.05, 0.001), 7) AS north, round(min(lon) - greatest((max(lon) - min(lon)) * 0.05, 0.001), 7) AS west, round(max(lon) + greatest((max(lon) - min(lon)) * 0.05, 0.001), 7) AS east FROM {FIX} GROUP BY 1")
def agg_21_extent(spark, sf):
    return fix(spark, sf).groupBy("session").agg(*(r(v, 7).alias(k) for k, v in metrics.extent("lat", "lon", 0.05, 0.001).items()))


@query(f"SELECT round(avg(pred), 4) AS mean, round(greatest(stddev_samp(pred), 0.000001), 4) AS sd FROM {PRED} WHERE run % 3 <> 0")
def agg_22_normalisation(spark, sf):
    return pred(spark, sf).where("run % 3 <> 0").agg(r(F.avg("pred"), 4).alias("mean"), r(F.greatest(F.stddev_samp("pred"), F.lit(1e-6)), 4).alias("sd"))


@query(f"SELECT run, round(CASE WHEN count(*) FILTER (truth > 40) = 0 THEN 1 ELSE CAST(count(*) FILTER (truth <= 40) AS DOUBLE) / count(*) FILTER (truth > 40) END, 6) AS weight FROM {PRED} GROUP BY 1")
def agg_23_class_weight(spark, sf):
    pos, neg = F.count(F.when(F.col("truth") > 40, 1)), F.count(F.when(F.col("truth") <= 40, 1))
    return pred(spark, sf).groupBy("run").agg(r(F.when(pos == 0, 1.0).otherwise(neg.cast("double") / F.nullif(pos, F.lit(0)))).alias("weight"))


@query(f"SELECT run % 3 AS split, count(*) AS n, round(avg(truth), 5) AS mean, round(stddev_pop(truth), 5) AS sd, min(truth) AS least, max(truth) AS most, round(avg(CASE WHEN truth >= 5 THEN 1.0 ELSE 0 END), 6) AS fast FROM {PRED} GROUP BY 1")
def agg_28_split_statistics(spark, sf):
    return pred(spark, sf).groupBy((F.col("run") % 3).alias("split")).agg(F.count("*").alias("n"), r(F.avg("truth"), 5).alias("mean"), r(F.stddev_pop("truth"), 5).alias("sd"), F.min("truth").alias("least"), F.max("truth").alias("most"), r(F.avg(F.when(F.col("truth") >= 5, 1.0).otherwise(0.0))).alias("fast"))


@query(f"SELECT min_by(run, (rmse, run)) AS best FROM (SELECT run, sqrt(avg({_E} * {_E})) AS rmse FROM {PRED} GROUP BY 1)")
def agg_30_best_of(spark, sf):
    return pred(spark, sf).groupBy("run").agg(metrics.rmse(F.col("pred") - F.col("truth")).alias("rmse")).agg(F.min_by("run", F.struct("rmse", "run")).alias("best"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_32_rollup(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


# sort, sets, arrays

@query("SELECT DISTINCT CAST(floor(alon / 0.002) AS BIGINT) AS cx, CAST(floor(alat / 0.002) AS BIGINT) AS cy FROM " + SEG + " UNION SELECT DISTINCT CAST(floor(blon / 0.002) AS BIGINT), CAST(floor(blat / 0.002) AS BIGINT) FROM " + SEG)
def set_02_cells(spark, sf):
    s = relation(spark, sf, "d_seg")
    cell = lambda e: s.select(*(F.expr(f"CAST(floor({e}{c} / 0.002D) AS BIGINT)").alias(n) for c, n in (("lon", "cx"), ("lat", "cy"))))
    return cell("a").union(cell("b")).distinct()


@query(f"SELECT cls, oneway, min(seg_id) AS seg_id FROM {SEG} GROUP BY 1, 2")
def set_01_keep_first(spark, sf):
    return relation(spark, sf, "d_seg").groupBy("cls", "oneway").agg(F.min("seg_id").alias("seg_id"))


@query(f"""WITH c AS (SELECT DISTINCT session AS row, seq - seq % 7 AS j FROM {FIX} WHERE acc > 25), i AS (SELECT row, j, (j / 7) - row_number() OVER (PARTITION BY row ORDER BY j) AS g FROM c)
SELECT row, min(j) AS a, max(j) AS b FROM i GROUP BY row, g""")
def set_04_cell_runs(spark, sf):
    c = fix(spark, sf).where("acc > 25").select(F.col("session").alias("row"), (F.col("seq") - F.col("seq") % 7).alias("j")).distinct()
    g = c.withColumn("g", F.col("j") / 7 - F.row_number().over(Window.partitionBy("row").orderBy("j")))
    return g.groupBy("row", "g").agg(F.min("j").alias("a"), F.max("j").alias("b")).drop("g")


@query(f"SELECT session, seq, lat AS alat, nlat AS blat FROM (SELECT session, seq, lat, lead(lat) {W} AS nlat FROM {FIX}) WHERE nlat IS NOT NULL")
def ar_01_polyline_segments(spark, sf):
    lines = fix(spark, sf).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "lat"))).alias("p"))
    pairs = lines.select("session", F.explode(F.expr("CASE WHEN size(p) > 1 THEN zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> named_struct('seq', a.seq, 'alat', a.lat, 'blat', b.lat)) ELSE array() END")).alias("s"))
    return pairs.select("session", "s.*")


@query("SELECT vec_id, round(CAST(list_extract(embedding, 1) AS DOUBLE) + CAST(list_extract(embedding, 17) AS DOUBLE), 6) AS c0, round(CAST(list_extract(embedding, 2) AS DOUBLE) + CAST(list_extract(embedding, 18) AS DOUBLE), 6) AS c1 FROM embeddings")
def ar_02_transpose(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("v"))
    e = e.withColumn("rows", F.expr("transform(sequence(0, 3), i -> slice(v, i * 16 + 1, 16))")).withColumn("cols", F.expr("transform(sequence(0, 15), c -> transform(rows, x -> x[c]))"))
    return e.select("vec_id", r(F.expr("cols[0][0] + cols[0][1]")).alias("c0"), r(F.expr("cols[1][0] + cols[1][1]")).alias("c1"))


@query(f"SELECT session, n, CAST(sum(n) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS at FROM (SELECT session, count(*) AS n FROM {FIX} GROUP BY 1)")
def ar_04_offsets(spark, sf):
    n = fix(spark, sf).groupBy("session").agg(F.count("*").alias("n"))
    return n.withColumn("at", F.sum("n").over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def ar_05_json(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[i + 32] AS DOUBLE))), 5) AS dot FROM embeddings")
def ar_06_cosine_parts(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", r(F.expr("aggregate(zip_with(slice(embedding, 1, 32), slice(embedding, 33, 32), (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), 0D, (s, x) -> s + x)"), 5).alias("dot"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
