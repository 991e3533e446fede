"""Queries of texts, reports, gates, sets and ranks over derived relations. Their SQL is written out by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import rotation, scalars, texts
from wayfold.operators import align, metrics, reports, windows
from wayfold.plans.fixtures import oracle, relation
from wayfold.plans.series_queries import fix, pred, r

_QUERIES, _SQL = {}, {}


def query(sql=None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


FIX, PRED, IMU, MATCH, DR, CHAN, SEG = (f"({oracle(n)})" for n in ("d_fix", "d_pred", "d_imu", "d_match", "d_dr", "d_chan", "d_seg"))
W = "OVER (PARTITION BY session ORDER BY seq)"


def great_circle(a: str, b: str, c: str, e: str) -> str:
    """Distance on the sphere in DuckDB, by the chord between two unit vectors."""
    x = f"cos(radians({a})) * cos(radians({b})) - cos(radians({c})) * cos(radians({e}))"
    y = f"cos(radians({a})) * sin(radians({b})) - cos(radians({c})) * sin(radians({e}))"
    z = f"sin(radians({a})) - sin(radians({c}))"
    half = f"sqrt(pow({x}, 2) + pow({y}, 2) + pow({z}, 2)) / 2"
    return f"(12742000 * asin(CASE WHEN {half} > 1 THEN 1 ELSE {half} END))"


# texts

@query(f"""SELECT session, seq, CASE WHEN acc * 100 >= 1000 THEN printf('%.2f km', round(acc / 10, 2)) ELSE printf('%.0f m', round(acc * 100)) END AS distance,
 CASE WHEN seq * 137 < 3600 THEN printf('%d:%02d', seq * 137 // 60, seq * 137 % 60) ELSE printf('%d:%02d:%02d', seq * 137 // 3600, seq * 137 % 3600 // 60, seq * 137 % 60) END AS duration,
 CASE WHEN event_id * 997 >= 1000000 THEN printf('%.1fM', round(event_id * 997 / 1000000, 1)) WHEN event_id * 997 >= 1000 THEN printf('%.1fk', round(event_id * 997 / 1000, 1)) ELSE CAST(event_id * 997 AS VARCHAR) END AS n FROM {FIX}""")
def scl_08_formats(spark, sf):
    return fix(spark, sf).select("session", "seq", texts.distance(F.col("acc") * 100).alias("distance"), texts.duration(F.col("seq") * 137).alias("duration"), texts.count(F.col("event_id") * 997).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'walk_' || event_id ELSE strftime(date_trunc('second', ts), '%b ') || day(ts) || strftime(ts, ', %Y · %H:%M') END AS date FROM events")
def scl_09_session_dates(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    name = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("walk_"), "event_id")).otherwise(F.date_format("ts", "yyyyMMdd_HHmmss"))
    return e.select("event_id", texts.session_date(name).alias("date"))


@query("SELECT p_partkey, CASE WHEN k IN (3, 4, 5, 6) THEN 'E' WHEN k = 0 THEN 'B' WHEN k = 1 THEN 'A' WHEN k = 2 THEN 'D' ELSE '?' END AS driver FROM (SELECT p_partkey, p_partkey % 9 AS k FROM part)")
def scl_10_drivers(spark, sf):
    prefix = F.element_at(F.array(*(F.lit(x) for x in ("M12", "S3a", "Y1", "Vf", "Vta9", "Vtb", "Vw2", "V", "X_S"))), (F.col("p_partkey") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", texts.driver(F.concat(prefix, F.lit("_r"), "p_size")).alias("driver"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE regexp_replace(p_name || ' (' || p_type || ')', ' \\(.*', '') END AS label FROM part")
def scl_11_label(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", texts.label(F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))).alias("label"))


@query("SELECT p_partkey, 'https://tile.example.org/15/' || p_partkey || '/' || p_size || '.png?q=' || replace(replace(p_brand, '#', '%23'), ' ', '+') AS url FROM part")
def scl_12_url_template(spark, sf):
    url = texts.from_template("https://tile.example.org/{z}/{x}/{y}.png?q={q}", z=F.lit(15), x=F.col("p_partkey"), y=F.col("p_size"), q=F.col("p_brand"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", url.alias("url"))


@query("SELECT p_partkey, left(sha1(p_name), 8) AS key FROM part")
def scl_14_src_15_cache_key(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", texts.cache_key(F.col("p_name")).alias("key"))


# gates

@query(f"""SELECT a.session, a.seq, abs(sqrt(a.v0 * a.v0 + a.v1 * a.v1 + a.v2 * a.v2) - CAST(9.80665 AS DOUBLE)) < CAST(0.15 AS DOUBLE) AND g.w < CAST(0.05 AS DOUBLE) AS standing
 FROM (SELECT * FROM {IMU} WHERE sensor = 'accel') a ASOF JOIN (SELECT session, t_ns, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS w FROM {IMU} WHERE sensor = 'gyro') g ON a.session = g.session AND a.t_ns >= g.t_ns""")
def flt_04_standing(spark, sf):
    i = relation(spark, sf, "d_imu")
    gyro = i.where("sensor = 'gyro'").select("session", "t_ns", F.sqrt(F.col("v0") ** 2 + F.col("v1") ** 2 + F.col("v2") ** 2).alias("w"))
    a = align.latest(i.where("sensor = 'accel'"), gyro, "session", "t_ns", "w").where("w IS NOT NULL")
    return a.select("session", "seq", F.expr(scalars.standing("v0", "v1", "v2", "w")).alias("standing"))


@query(f"SELECT session, s AS start, count(v) = 10 AS whole FROM (SELECT a.session, a.seq AS s, CASE WHEN b.event_id % 23 > 0 THEN b.speed END AS v FROM {FIX} a JOIN {FIX} b ON a.session = b.session AND b.seq BETWEEN a.seq AND a.seq + 9 JOIN (SELECT session, max(seq) AS m FROM {FIX} GROUP BY 1) c ON c.session = a.session WHERE a.seq % 5 = 0 AND a.seq + 9 <= m) GROUP BY 1, 2")
def flt_10_whole_windows(spark, sf):
    f = fix(spark, sf).withColumn("v", F.when(F.col("event_id") % 23 > 0, F.col("speed")).otherwise(F.lit(float("nan"))))
    s = windows.sliding(f, "session", "seq", "v", 10, 5)
    return s.select("session", F.col("start").cast("long").alias("start"), (~F.exists("window", lambda x: x.isNull() | F.isnan(x))).alias("whole"))


@query(f"""SELECT s.session, s.t_s, i.speed FROM (SELECT session, t0 + k * 10 AS t_s FROM (SELECT session, min(t_s) + CAST(0.5 AS DOUBLE) AS t0, max(t_s) AS t1 FROM {FIX} GROUP BY 1), range(0, 1000) x(k) WHERE t0 + k * 10 + 10 <= t1) s
 ASOF JOIN (SELECT session, t_s, speed, lead(t_s) {W} AS nt FROM {FIX}) i ON i.session = s.session AND s.t_s <= i.t_s WHERE i.speed >= 3 AND i.nt IS NOT NULL""")
def flt_11_outages(spark, sf):
    f = fix(spark, sf)
    span = f.groupBy("session").agg((F.min("t_s") + 0.5).alias("t0"), F.max("t_s").alias("t1"))
    starts = windows.tiles(span, "session", "t0", "t1", 10.0, 10.0).select("session", F.col("start").alias("t_s"))
    return reports.admissible_outages(starts, f, "session", "t_s", 10.0, 3.0)


@query(f"SELECT session, seq // 20 AS w, round(sum(speed), 4) AS metres FROM {FIX} GROUP BY 1, 2 HAVING sum(speed) > 100")
def flt_12_far_windows(spark, sf):
    return fix(spark, sf).groupBy("session", F.floor(F.col("seq") / 20).cast("long").alias("w")).agg(F.sum("speed").alias("m")).where("m > 100").select("session", "w", r("m", 4).alias("metres"))


@query(f"SELECT session, seq, used % 5 >= 4 AND acc >= 20 AS over FROM {FIX}")
def flt_18_hand_over(spark, sf):
    return fix(spark, sf).select("session", "seq", reports.hand_over(F.col("used") % 5 + 0.0, F.col("acc") + 40).alias("over"))


@query(f"""SELECT session, tiles, tiles <= 4000 AS fits FROM (SELECT session, (floor((max(lon) + session % 7 + 180) / 360 * 32768) - floor((min(lon) + 180) / 360 * 32768) + 1) *
 (floor((1 - asinh(tan(radians(min(lat)))) / pi()) / 2 * 32768) - floor((1 - asinh(tan(radians(max(lat) + CAST(0.05 AS DOUBLE)))) / pi()) / 2 * 32768) + 1) AS tiles FROM {FIX} GROUP BY 1)""")
def flt_23_tile_budget(spark, sf):
    from wayfold.operators.corridor import tile_count

    box = fix(spark, sf).groupBy("session").agg(F.min("lat").alias("south"), (F.max("lat") + 0.05).alias("north"), F.min("lon").alias("west"), (F.max("lon") + F.col("session") % 7).alias("east"))
    return box.select("session", F.expr(tile_count("south", "west", "north", "east", 15)).cast("double").alias("tiles")).withColumn("fits", F.col("tiles") <= 4000)


@query(f"SELECT run, round(sqrt(avg((pred - truth) * (pred - truth))), 5) AS rmse, coalesce(sqrt(avg((pred - truth) * (pred - truth))) < stddev_pop(truth) AND corr(pred, truth) > CAST(0.5 AS DOUBLE), false) AS fit FROM {PRED} GROUP BY 1")
def flt_24_verdict(spark, sf):
    s = metrics.score("pred", "truth")
    return reports.verdict(pred(spark, sf).groupBy("run").agg(*(s[k].alias(k) for k in ("rmse", "constant_rmse", "r")))).select("run", r("rmse", 5).alias("rmse"), "fit")


# reports

_CORRECTION = "sqrt(pow((snap_lat - dr_lat) * 111132, 2) + pow((snap_lon - dr_lon) * 111132 * cos(radians((snap_lat + dr_lat) / 2)), 2))"


def _matches(spark, sf):
    from wayfold.functions import geo

    return relation(spark, sf, "d_match").withColumn("correction", F.expr(geo.local_metres("dr_lat", "dr_lon", "snap_lat", "snap_lon")))


@query(f"SELECT session, count(*) AS matches, round(avg(c), 4) AS mean, round(median(c), 4) AS median, round(quantile_cont(c, 0.9), 4) AS p90, round(max(c), 4) AS most, round(avg(confidence), 5) AS mean_confidence, round(100 * avg(CASE WHEN confidence < CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END), 4) AS unsure FROM (SELECT *, {_CORRECTION} AS c FROM {MATCH}) GROUP BY 1")
def agg_12_match_report(spark, sf):
    m = reports.match_report(_matches(spark, sf), "session")
    return m.select("session", "matches", *(r(c, 4).alias(c) for c in ("mean", "median", "p90", "most")), r("mean_confidence", 5).alias("mean_confidence"), r("unsure", 4).alias("unsure"))


@query(f"""WITH m AS (SELECT *, 111132 * cos(radians(avg(snap_lat) OVER (PARTITION BY session))) AS k, lag(t_s) {W} AS pt, lag(snap_lat) {W} AS a, lag(snap_lon) {W} AS b, lag(dr_lat) {W} AS c, lag(dr_lon) {W} AS e FROM {MATCH}),
x AS (SELECT session, seq, t_s - pt AS dt, sqrt(pow((snap_lon - b) * k, 2) + pow((snap_lat - a) * 111132, 2)) - sqrt(pow((dr_lon - e) * k, 2) + pow((dr_lat - c) * 111132, 2)) AS excess FROM m)
SELECT session, seq, round(excess, 3) AS excess FROM x WHERE excess > 15 AND dt < 5""")
def win_20_jumps(spark, sf):
    return reports.snap_jumps(_matches(spark, sf), "session", "seq", "t_s").select("session", "seq", r("excess", 3).alias("excess"))


_ERRORS = f"(SELECT session, seq, matched, {great_circle('dr_lat', 'dr_lon', 'lat', 'lon')} AS e_dr, {great_circle('snap_lat', 'snap_lon', 'lat', 'lon')} AS e_snap FROM {MATCH})"


@query(f"SELECT session, count(*) AS n, count(*) FILTER (matched) AS matched, round(avg(e_snap), 3) AS mean_error, round(avg(e_dr), 3) AS mean_unaided, round(quantile_cont(e_snap, 0.9), 3) AS p90_error, round(100 * avg(CASE WHEN e_snap < e_dr THEN 1 ELSE 0 END) FILTER (matched), 3) AS helped FROM {_ERRORS} GROUP BY 1")
def agg_13_matcher_summary(spark, sf):
    from wayfold.functions import geo

    m = relation(spark, sf, "d_match").withColumns({"e_dr": F.expr(geo.haversine("dr_lat", "dr_lon", "lat", "lon")), "e_snap": F.expr(geo.haversine("snap_lat", "snap_lon", "lat", "lon"))})
    s = reports.matcher_summary(m, "session")
    return s.select("session", "n", "matched", *(r(c, 3).alias(c) for c in ("mean_error", "mean_unaided", "p90_error", "helped")))


_SHARES = ("dropped", "zupt", "false_zupt", "speed", "true_speed", "ratio", "shortfall")


@query(f"""SELECT session, count(*) AS samples, round(100.0 * count(*) FILTER (NOT accepted) / count(*), 4) AS dropped, round(100.0 * count(*) FILTER (accepted AND still) / count(*) FILTER (accepted), 4) AS zupt,
 round(100.0 * count(*) FILTER (accepted AND still AND truth > 1) / nullif(count(*) FILTER (accepted AND truth > 1), 0), 4) AS false_zupt, round(avg(speed) FILTER (accepted AND truth > 1), 4) AS speed, round(avg(truth) FILTER (accepted AND truth > 1), 4) AS true_speed,
 round(sum(step_m) FILTER (accepted) / sum(true_m), 4) AS ratio, round(100 - 100 * sum(step_m) FILTER (accepted) / sum(true_m), 4) AS shortfall FROM {DR} GROUP BY 1""")
def agg_24_integrator_report(spark, sf):
    s = reports.integrator_report(relation(spark, sf, "d_dr"), "session")
    return s.select("session", "samples", *(r(c, 4).alias(c) for c in _SHARES))


_PARTS = ("speed_bias", "speed_rmse", "speed_percent", "speed_r", "yaw_bias", "yaw_rmse", "yaw_r", "heading_per_hour")


@query(f"""SELECT session, round(avg(model_speed - speed), 4) AS speed_bias, round(sqrt(avg(pow(model_speed - speed, 2))), 4) AS speed_rmse, round(100 * (avg(model_speed) / avg(speed) - 1), 4) AS speed_percent, round(corr(speed, model_speed), 4) AS speed_r,
 round(avg(model_yaw - yaw) * 180 / pi(), 4) AS yaw_bias, round(sqrt(avg(pow(model_yaw - yaw, 2))) * 180 / pi(), 4) AS yaw_rmse, round(corr(yaw, model_yaw), 4) AS yaw_r, round(avg(sgn * model_yaw - sgn * yaw) * 180 / pi() * 3600, 4) AS heading_per_hour FROM {CHAN} GROUP BY 1""")
def agg_25_channels(spark, sf):
    s = reports.channel_attribution(relation(spark, sf, "d_chan"), "session", "sgn")
    return s.select("session", *(r(c, 4).alias(c) for c in _PARTS))


@query(f"SELECT gate, session % 4 AS part, count(*) FILTER (speed >= gate) AS n, round(avg(acc) FILTER (speed >= gate), 5) AS mean FROM {FIX}, (SELECT unnest([0, 2, 5, 9]) AS gate) GROUP BY 1, 2")
def agg_26_sweep(spark, sf):
    gates = spark.createDataFrame([(g,) for g in (0, 2, 5, 9)], "gate int")
    on = F.col("speed") >= F.col("gate")
    return reports.sweep(fix(spark, sf).withColumn("part", F.col("session") % 4), gates, ["part"], {"n": F.count(F.when(on, 1)), "mean": r(F.avg(F.when(on, F.col("acc"))), 5)})


@query(f"""WITH e AS (SELECT session, last(lat ORDER BY seq) AS a, last(lon ORDER BY seq) AS b, last(dr_lat ORDER BY seq) AS c, last(dr_lon ORDER BY seq) AS d, max(seq) AS m, last(snap_lat ORDER BY seq) FILTER (matched) AS s, last(snap_lon ORDER BY seq) FILTER (matched) AS t FROM {MATCH} GROUP BY 1),
o AS (SELECT session, last(dr_lat ORDER BY seq) AS x, last(dr_lon ORDER BY seq) AS y FROM {MATCH} WHERE session % 5 > 0 AND seq % 7 = 0 GROUP BY 1),
p AS (SELECT session, sum({great_circle('lag_lat', 'lag_lon', 'lat', 'lon')}) AS driven FROM (SELECT session, lat, lon, lag(lat) {W} AS lag_lat, lag(lon) {W} AS lag_lon FROM {MATCH}) WHERE lag_lat IS NOT NULL GROUP BY 1),
q AS (SELECT e.session, {great_circle('x', 'y', 'a', 'b')} AS original, {great_circle('c', 'd', 'a', 'b')} AS new, {great_circle('s', 't', 'a', 'b')} AS matched, coalesce(driven, 0) AS driven FROM e LEFT JOIN o USING (session) LEFT JOIN p USING (session))
SELECT session, round(original, 3) AS original, round(new, 3) AS new, round(matched, 3) AS matched, round(driven, 2) AS driven, round(CASE WHEN original > 0 THEN 100 * (original - new) / original ELSE 0 END, 2) AS improvement FROM q""")
def agg_27_drift_totals(spark, sf):
    m = relation(spark, sf, "d_match")
    dr = m.select("session", "seq", F.col("dr_lat").alias("lat"), F.col("dr_lon").alias("lon"))
    snap = m.where("matched").select("session", "seq", F.col("snap_lat").alias("lat"), F.col("snap_lon").alias("lon"))
    t = reports.drift_totals(m.select("session", "seq", "lat", "lon"), dr.where("session % 5 > 0 AND seq % 7 = 0"), dr, snap, "session", "seq")
    return t.select("session", *(r(c, 3).alias(c) for c in ("original", "new", "matched")), r("driven", 2).alias("driven"), r("improvement", 2).alias("improvement"))


@query(f"""WITH g AS (SELECT session, t_s, speed FROM {FIX} WHERE acc <= 30), t AS (SELECT session, t_s + CAST(0.25 AS DOUBLE) AS t_s, speed FROM {DR}),
x AS (SELECT t.session, t.speed, coalesce(p.speed + (n.speed - p.speed) * (t.t_s - p.t_s) / nullif(n.t_s - p.t_s, 0), p.speed, n.speed) AS truth FROM t ASOF LEFT JOIN g p ON p.session = t.session AND t.t_s >= p.t_s ASOF LEFT JOIN g n ON n.session = t.session AND t.t_s <= n.t_s)
SELECT session, count(*) FILTER (truth > 2) AS n, CASE WHEN count(*) FILTER (truth > 2) >= 50 THEN round(sqrt(avg(pow(speed - truth, 2)) FILTER (truth > 2)), 4) END AS rmse FROM x GROUP BY 1""")
def agg_34_unaided_baseline(spark, sf):
    track = relation(spark, sf, "d_dr").withColumn("t_s", F.col("t_s") + 0.25)
    return reports.unaided_baseline(track, fix(spark, sf), "session", "t_s").select("session", "n", r("rmse", 4).alias("rmse"))


_A, _F = "6378137.0", "(1 / 298.257223563)"


@query(f"""WITH RECURSIVE p AS (SELECT session, seq, atan((1 - {_F}) * tan(radians(lat))) AS u1, atan((1 - {_F}) * tan(radians(lat + CAST(0.3 AS DOUBLE)))) AS u2, radians(CAST(0.2 AS DOUBLE) + seq * CAST(0.001 AS DOUBLE)) AS l FROM {FIX}),
v AS (SELECT session, seq, u1, u2, l, l AS lam, 0 AS k, CAST(0 AS DOUBLE) AS ss, CAST(0 AS DOUBLE) AS cs, CAST(0 AS DOUBLE) AS ca, CAST(0 AS DOUBLE) AS cm FROM p UNION ALL
 SELECT session, seq, u1, u2, l, l + (1 - c) * {_F} * sa * (atan2(ss2, cs2) + c * ss2 * (cm2 + c * cs2 * (2 * cm2 * cm2 - 1))), k + 1, ss2, cs2, ca2, cm2 FROM
 (SELECT *, {_F} / 16 * ca2 * (4 + {_F} * (4 - 3 * ca2)) AS c FROM (SELECT *, cs2 - 2 * sin(u1) * sin(u2) / ca2 AS cm2 FROM (SELECT *, 1 - sa * sa AS ca2 FROM (SELECT *, cos(u1) * cos(u2) * sin(lam) / ss2 AS sa FROM
 (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss2, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs2 FROM v WHERE k < 12) i1) i2) i3) i4) i5),
w AS (SELECT *, ca * (1 / pow(1 - {_F}, 2) - 1) AS q FROM v WHERE k = 12)
SELECT session, seq, round({_A} * (1 - {_F}) * (1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))) * (atan2(ss, cs) - b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) AS metres FROM
 (SELECT *, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS b FROM w)""")
def geo_06_geodesic(spark, sf):
    f = fix(spark, sf).withColumns({"lat1": F.col("lat") + 0.3, "lon1": F.col("lon") + 0.2 + F.col("seq") * 0.001})
    return f.select("session", "seq", r(reports.geodesic_metres("lat", "lon", "lat1", "lon1"), 3).alias("metres"))


@query(f"""WITH m AS (SELECT session, median(v0) AS a, median(v1) AS b, median(v2) AS c FROM {IMU} WHERE sensor = 'accel' GROUP BY 1),
n AS (SELECT session, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b, c / sqrt(a * a + b * b + c * c) AS c FROM m)
SELECT session, round(a, 6) AS d0, round(b, 6) AS d1, round(c, 6) AS d2, round(sqrt(b * b + c * c), 6) AS e0, round(-a * b / sqrt(b * b + c * c), 6) AS e1, round(-a * c / sqrt(b * b + c * c), 6) AS e2, CAST(0 AS DOUBLE) AS f0, round(c / sqrt(b * b + c * c), 6) AS f1, round(-b / sqrt(b * b + c * c), 6) AS f2 FROM n""")
def rot_14_tilt_frame(spark, sf):
    t = reports.tilt_frame(relation(spark, sf, "d_imu").where("sensor = 'accel'"), "session", ("v0", "v1", "v2"))
    return t.select("session", *(r(f"{p}{i}").alias(f"{p}{i}") for p in "def" for i in range(3)))


@query(f"SELECT session, round(CASE WHEN count(*) FILTER (speed < 12) > 50 THEN avg(acc) FILTER (speed < 12) ELSE 0 END, 6) AS bias FROM {FIX} GROUP BY 1")
def agg_18_standing_mean(spark, sf):
    return fix(spark, sf).groupBy("session").agg(r(metrics.still_mean("acc", F.col("speed") < 12)).alias("bias"))


@query(f"SELECT label, round(count(DISTINCT (least(5, floor(3 * (z / n + 1))), least(11, floor((atan2(y, x) / pi() + 1) * 6)))) / CAST(72 AS DOUBLE), 6) AS coverage FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM ({oracle('d_quat')})) GROUP BY 1")
def agg_29_st_08_coverage(spark, sf):
    cell = F.expr(rotation.sphere_cell("x", "y", "z"))
    return relation(spark, sf, "d_quat").groupBy("label").agg(r(F.countDistinct(cell) / 72.0).alias("coverage"))


# ranks, orders and sets

@query(f"SELECT session, seq, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense, CAST(ntile(4) OVER (PARTITION BY session ORDER BY acc, seq) AS BIGINT) AS quarter, round(cume_dist() OVER w, 6) AS share, round(sum(speed) OVER (PARTITION BY session ORDER BY t_s RANGE BETWEEN 10 PRECEDING AND CURRENT ROW), 4) AS ten FROM {FIX} WINDOW w AS (PARTITION BY session ORDER BY acc)")
def win_22_ranks(spark, sf):
    w, ten = Window.partitionBy("session").orderBy("acc"), Window.partitionBy("session").orderBy("t_s").rangeBetween(-10, 0)
    q = F.ntile(4).over(Window.partitionBy("session").orderBy("acc", "seq"))
    return fix(spark, sf).select("session", "seq", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), q.cast("long").alias("quarter"), r(F.cume_dist().over(w)).alias("share"), r(F.sum("speed").over(ten), 4).alias("ten"))


@query(f"SELECT session, CAST(row_number() OVER (ORDER BY t DESC, session) AS BIGINT) AS newest, CAST(row_number() OVER (ORDER BY d ASC NULLS LAST, session) AS BIGINT) AS nearest FROM (SELECT session, max(t_s) AS t, min(CASE WHEN session % 4 > 0 THEN acc END) AS d FROM {FIX} GROUP BY 1)")
def srt_03_orders(spark, sf):
    s = fix(spark, sf).groupBy("session").agg(F.max("t_s").alias("t"), F.min(F.when(F.col("session") % 4 > 0, F.col("acc"))).alias("d"))
    place = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("long")  # noqa: E731  (one row for each session)
    return s.select("session", place(F.desc("t"), "session").alias("newest"), place(F.asc_nulls_last("d"), "session").alias("nearest"))


@query(f"""WITH s AS (SELECT session, seq // 6 AS g, seq AS seg_id, -acc / 10 AS score, bearing FROM {FIX}), b AS (SELECT *, first(bearing) OVER w AS hb, first(score) OVER w AS hs, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY session, g ORDER BY score DESC, seg_id)),
x AS (SELECT *, least(abs((bearing - hb + 540) % 360 - 180), 180 - abs((bearing - hb + 540) % 360 - 180)) AS off FROM b), y AS (SELECT session, g, max(hs) AS best, max(score) FILTER (off > 30) AS rival FROM x GROUP BY 1, 2)
SELECT session, g, round(CASE WHEN rival IS NULL THEN 1 ELSE exp(best) / (exp(best) + exp(rival)) END, 6) AS confidence FROM y""")
def srt_04_rivals(spark, sf):
    s = fix(spark, sf).select("session", F.floor(F.col("seq") / 6).cast("long").alias("g"), F.col("seq").alias("seg_id"), (-F.col("acc") / 10).alias("score"), "bearing")
    return reports.rival(s, ["session", "g"], "score", "bearing").select("session", "g", r(reports.confidence(F.col("best"), F.col("rival"))).alias("confidence"))


@query(f"SELECT run, n, CAST(row_number() OVER (ORDER BY n DESC, run) AS BIGINT) AS place FROM (SELECT run, count(*) AS n FROM {PRED} GROUP BY 1)")
def srt_05_longest_first(spark, sf):
    s = pred(spark, sf).groupBy("run").agg(F.count("*").alias("n"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "run")).cast("long"))


@query(f"SELECT 'fix' AS part, session, seq, speed AS v FROM {FIX} UNION ALL SELECT 'integrator', session, seq, step_m FROM {DR}")
def set_03_concatenated(spark, sf):
    a = fix(spark, sf).select(F.lit("fix").alias("part"), "session", "seq", F.col("speed").alias("v"))
    return a.unionByName(relation(spark, sf, "d_dr").select(F.lit("integrator").alias("part"), "session", "seq", F.col("step_m").alias("v")))


@query(f"(SELECT 'both' AS part, session, used FROM {FIX} WHERE acc < 20 INTERSECT SELECT 'both', session, used FROM {FIX} WHERE speed > 10) UNION ALL (SELECT 'first', session, used FROM {FIX} WHERE acc < 20 EXCEPT SELECT 'first', session, used FROM {FIX} WHERE speed > 10)")
def set_06_intersect_except(spark, sf):
    f = fix(spark, sf)
    a, b = f.where("acc < 20").select("session", "used"), f.where("speed > 10").select("session", "used")
    return a.intersect(b).select(F.lit("both").alias("part"), "session", "used").union(a.exceptAll(b).distinct().join(b.distinct(), ["session", "used"], "left_anti").select(F.lit("first").alias("part"), "session", "used"))


@query(f"""SELECT coalesce(a.session, b.session) AS session, a.n AS slow, b.n AS fast, (SELECT count(*) FROM (SELECT run, count(*) AS c FROM {PRED} GROUP BY 1) p WHERE p.c BETWEEN a.n AND a.n + b.n) AS between_them FROM
 (SELECT session, count(*) AS n FROM {FIX} WHERE speed < 1 AND session % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT session, count(*) AS n FROM {FIX} WHERE speed > 12 AND session % 4 > 0 GROUP BY 1) b ON a.session = b.session""")
def jn_20_full_and_theta(spark, sf):
    f = fix(spark, sf)
    a = f.where("speed < 1 AND session % 3 > 0").groupBy("session").agg(F.count("*").alias("slow"))
    b = f.where("speed > 12 AND session % 4 > 0").groupBy("session").agg(F.count("*").alias("fast"))
    both = a.join(b, "session", "full")
    runs = pred(spark, sf).groupBy("run").agg(F.count("*").alias("c"))
    met = both.join(runs, (F.col("c") >= F.col("slow")) & (F.col("c") <= F.col("slow") + F.col("fast"))).groupBy("session").agg(F.count("*").alias("m"))
    return both.join(met, "session", "left").select("session", "slow", "fast", F.coalesce("m", F.lit(0)).cast("long").alias("between_them"))


@query(f"SELECT session, seq // 10 AS w, list_concat(list(speed ORDER BY seq), list(acc ORDER BY seq)) AS x FROM {FIX} GROUP BY 1, 2")
def ar_03_concatenated(spark, sf):
    g = fix(spark, sf).groupBy("session", F.floor(F.col("seq") / 10).cast("long").alias("w")).agg(F.array_sort(F.collect_list(F.struct("seq", "speed", "acc"))).alias("s"))
    return g.select("session", "w", F.concat(F.transform("s", lambda x: x["speed"]), F.transform("s", lambda x: x["acc"])).alias("x"))


@query(f"SELECT seg_id, map {{'primary': 3, 'residential': 1}}[cls] AS rank FROM {SEG}")
def ar_07_lookup(spark, sf):
    ranks = F.create_map(F.lit("primary"), F.lit(3), F.lit("residential"), F.lit(1))
    return relation(spark, sf, "d_seg").select("seg_id", F.try_element_at(ranks, F.col("cls")).alias("rank"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
