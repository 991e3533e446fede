"""Queries of signals, training sets and model scores over derived relations. Their SQL is written out by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.operators import learning, losses, training
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


FIX, PRED, IMU, CHAN = (f"({oracle(n)})" for n in ("d_fix", "d_pred", "d_imu", "d_chan"))
W = "OVER (PARTITION BY session ORDER BY seq)"
UPTO = "OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)"


# signals

@query(f"""SELECT session, round(a / s, 6) AS u0, round(b / s, 6) AS u1, round(c / s, 6) AS u2 FROM (SELECT *, sqrt(a * a + b * b + c * c) AS s FROM (SELECT session, CASE WHEN count(*) >= 10 THEN avg(v0) ELSE 0 END AS a,
 CASE WHEN count(*) >= 10 THEN avg(v1) ELSE 0 END AS b, CASE WHEN count(*) >= 10 THEN avg(v2) ELSE 1 END AS c FROM {IMU} WHERE sensor = 'accel' GROUP BY 1))""")
def sig_03_vertical_axis(spark, sf):
    a = training.vertical_axis(relation(spark, sf, "d_imu").where("sensor = 'accel'"), "session", ("v0", "v1", "v2"))
    return a.select("session", *(r(f"u{i}").alias(f"u{i}") for i in range(3)))


@query(f"SELECT session, round(abs(corr(speed, bearing)), 5) AS r_speed, round(abs(corr(acc, bearing)), 5) AS r_acc, CASE WHEN abs(corr(speed, bearing)) >= abs(corr(acc, bearing)) THEN 'speed' ELSE 'acc' END AS axis FROM {FIX} GROUP BY 1")
def sig_04_axis_ranking(spark, sf):
    a = training.axis_ranking(fix(spark, sf), "session", ["speed", "acc"], "bearing")
    return a.select("session", r("r_speed", 5).alias("r_speed"), r("r_acc", 5).alias("r_acc"), "axis")


@query(f"""WITH a AS (SELECT session, seq, lat, lon, 111132 * cos(radians(first_value(lat) {W})) AS k, first_value(lat) {W} AS lat0, first_value(lon) {W} AS lon0 FROM {FIX}),
b AS (SELECT *, (lon - lon0) * k AS x, (lat - lat0) * 111132 AS y FROM a), c AS (SELECT *, coalesce(sqrt(pow(x - lag(x) {W}, 2) + pow(y - lag(y) {W}, 2)), 0) AS s FROM b),
d AS (SELECT *, sum(s) {UPTO} AS way FROM c), e AS (SELECT session, max(way) AS total, sqrt(pow(last(x ORDER BY seq), 2) + pow(last(y ORDER BY seq), 2)) AS chord FROM d GROUP BY 1),
f AS (SELECT d.*, total, chord, CAST(0.3 AS DOUBLE) * way / nullif(chord, 0) AS th FROM d JOIN e USING (session))
SELECT session, seq, round(CASE WHEN total >= 1 AND chord >= 1 THEN lat0 + (sin(th) * x + cos(th) * y) / 111132 ELSE lat END, 7) AS lat, round(CASE WHEN total >= 1 AND chord >= 1 THEN lon0 + (cos(th) * x - sin(th) * y) / k ELSE lon END, 7) AS lon FROM f""")
def sig_05_injected_drift(spark, sf):
    return training.injected_drift(fix(spark, sf), "session", "seq", 0.15).select("session", "seq", r("drift_lat", 7).alias("lat"), r("drift_lon", 7).alias("lon"))


_YAW = f"""(WITH m AS (SELECT session, seq, t_s, bearing, ((bearing - lag(bearing) {W} + 540) % 360) - 180 AS st FROM {FIX} WHERE speed >= CAST(1.5 AS DOUBLE)),
u AS (SELECT session, seq, t_s, radians(first_value(bearing) {W} + sum(coalesce(st, 0)) {UPTO}) AS u, count(*) OVER (PARTITION BY session) AS n FROM m),
g AS (SELECT *, lag(u) {W} AS a, lead(u) {W} AS b, t_s - lag(t_s) {W} AS h, lead(t_s) {W} - t_s AS k FROM u)
SELECT session, seq, least(greatest(CASE WHEN a IS NULL THEN (b - u) / k WHEN b IS NULL THEN (u - a) / h ELSE (u - a) / h * k / (h + k) + (b - u) / k * h / (h + k) END, CAST(-1.5 AS DOUBLE)), CAST(1.5 AS DOUBLE)) AS yaw FROM g WHERE n > 2)"""


@query(f"SELECT f.session, f.seq, round(coalesce(yaw, 0), 5) AS yaw_rate FROM {FIX} f LEFT JOIN {_YAW} y ON f.session = y.session AND f.seq = y.seq")
def sig_06_yaw_labels(spark, sf):
    return training.yaw_labels(fix(spark, sf), "session", "seq", "t_s").select("session", "seq", r("yaw_rate", 5).alias("yaw_rate"))


@query(f"""WITH m AS (SELECT session, seq, yaw, bearing, ((bearing - lag(bearing) {W} + 540) % 360) - 180 AS st FROM {CHAN}), u AS (SELECT *, first_value(bearing) {W} + sum(coalesce(st, 0)) {UPTO} AS u FROM m),
g AS (SELECT session, yaw, radians(CASE WHEN lag(u) {W} IS NULL THEN lead(u) {W} - u WHEN lead(u) {W} IS NULL THEN u - lag(u) {W} ELSE (lead(u) {W} - lag(u) {W}) / 2 END) * 10 AS g FROM u)
SELECT session, CASE WHEN count(*) FILTER (abs(g) < 1) >= 100 AND corr(g, yaw) FILTER (abs(g) < 1) > 0 THEN 1 ELSE -1 END AS sign FROM g GROUP BY 1""")
def win_17_sign_convention(spark, sf):
    return training.sign_convention(relation(spark, sf, "d_chan"), "session", "seq", "bearing", "yaw")


def _runs(spark, sf):
    """A device and a vehicle for each session; the device is three rows behind."""
    f = fix(spark, sf)
    speed = F.sin(F.col("seq") * 0.37) * 5 + F.sin(F.col("seq") * 0.11 + F.col("session")) * 4 + 9
    turn = F.sin(F.col("seq") * 0.23 + F.col("session")) * 12
    late = lambda c: F.lag(c, 3).over(training.by("session", "seq"))
    v = f.select("session", "seq", "lat", "lon", speed.alias("vspeed"), turn.alias("vyaw"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    v = v.withColumns({"speed": F.coalesce(late("vspeed"), F.col("vspeed")), "gz": F.radians(F.coalesce(late("vyaw"), F.col("vyaw")))})
    return v.withColumns({"ax": F.lit(0.0), "ay": F.lit(0.0), "az": F.lit(9.8), "gx": F.lit(0.0), "gy": F.lit(0.0), "slat": F.coalesce(late("vlat"), F.col("vlat")), "slon": F.coalesce(late("vlon"), F.col("vlon"))})


@query(f"""WITH v AS (SELECT session, seq, sin(seq * CAST(0.23 AS DOUBLE) + session) * 12 AS t FROM {FIX}), g AS (SELECT session, seq, t, coalesce(lag(t, 3) {W}, t) AS d FROM v),
x AS (SELECT session, seq, radians(d) - avg(radians(d)) OVER (PARTITION BY session) AS a, radians(t) - avg(radians(t)) OVER (PARTITION BY session) AS b FROM g), c AS (SELECT x.session, x.seq - y.seq AS lag, sum(x.a * y.b) AS s FROM x JOIN x y ON y.session = x.session GROUP BY 1, 2),
n AS (SELECT session, sqrt(sum(a * a) * sum(b * b)) AS d FROM x GROUP BY 1) SELECT n.session, arg_max(lag, s) AS lag, round(max(s) / max(d), 6) AS r, 1 AS sign FROM c JOIN n ON n.session = c.session GROUP BY 1 HAVING count(*) >= 31 UNION ALL SELECT session, 0, 0, 1 FROM {FIX} GROUP BY 1 HAVING count(*) < 16""")
def sig_02_fine_lags(spark, sf):
    return training.fine_lags(_runs(spark, sf), "session", "seq", ("gx", "gy", "gz"), ("ax", "ay", "az"), "vyaw").withColumn("r", r("r"))


@query()
def sig_07_aligned_runs(spark, sf):
    return training.aligned_runs(_runs(spark, sf), "session", "seq", {"rows": 40, "every": 7})


@query(f"SELECT session, round(median(d), 4) AS median, round(quantile_cont(d, 0.9), 4) AS p90 FROM (SELECT session, sqrt(pow((slon - lon) * 111132 * cos(radians(lat)), 2) + pow((slat - lat) * 111132, 2)) AS d FROM (SELECT session, lat, lon, seq, lat + CAST(0.0001 AS DOUBLE) * (event_id % 4) AS slat, lon AS slon FROM {FIX}) WHERE seq % 331 = 0 OR seq % 11 = 0) GROUP BY 1")
def agg_20_offset_sample(spark, sf):
    p = fix(spark, sf).select("session", "seq", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"), (F.col("lat") + F.lit(0.0001) * (F.col("event_id") % 4)).alias("slat"), F.col("lon").alias("slon"))
    both = p.withColumn("seq", F.when((F.col("seq") % 331 == 0) | (F.col("seq") % 11 == 0), F.lit(0)).otherwise(F.lit(1)))  # short sessions: every 11th row stands for one of 331
    return training.position_offsets(both, "session", "seq").select("session", r("median", 4).alias("median"), r("p90", 4).alias("p90"))


@query(f"""SELECT session, CASE WHEN count(*) FILTER (speed < CAST(0.5 AS DOUBLE)) >= 3 THEN round(avg(acc) FILTER (speed < CAST(0.5 AS DOUBLE)), 5) ELSE round(median(acc), 5) END AS b0,
 CASE WHEN count(*) FILTER (speed < CAST(0.5 AS DOUBLE)) >= 3 THEN round(avg(bearing) FILTER (speed < CAST(0.5 AS DOUBLE)), 5) ELSE round(median(bearing), 5) END AS b1 FROM {FIX} GROUP BY 1""")
def agg_19_run_bias(spark, sf):
    b = training.run_biases(fix(spark, sf), "session", ["acc", "bearing"], "speed", 3)
    return b.select("session", r("b0", 5).alias("b0"), r("b1", 5).alias("b1"))


# training sets

@query(f"""WITH a AS (SELECT session, seq, avg(v0) AS lx, avg(v1) AS ly, avg(v2) AS lz FROM {IMU} WHERE sensor = 'accel' GROUP BY 1, 2), g AS (SELECT session, seq, v0 AS gx FROM {IMU} WHERE sensor = 'gyro'), q AS (SELECT session, seq, v2 AS z, v3 AS w FROM {IMU} WHERE sensor = 'rv'),
f AS (SELECT session, seq, speed FROM {FIX}), x AS (SELECT session, seq, gx, (1 - 2 * z * z) * lx - 2 * z * w * ly AS ex, lz AS ez, speed FROM a JOIN g USING (session, seq) JOIN q USING (session, seq) JOIN f USING (session, seq))
SELECT s.session, s.seq AS start, round(sum(x.ex), 5) AS ex, round(sum(x.ez), 5) AS ez, round(sum(x.gx), 6) AS gx, max(l.speed) AS speed, CAST(max(l.speed) < CAST(0.5 AS DOUBLE) AS INTEGER) AS stationary
 FROM x s JOIN x ON x.session = s.session AND x.seq BETWEEN s.seq AND s.seq + 19 JOIN x l ON l.session = s.session AND l.seq = s.seq + 19 JOIN (SELECT session, max(seq) AS m FROM x GROUP BY 1) c ON c.session = s.session WHERE s.seq % 10 = 0 AND s.seq < m + 1 - 20 GROUP BY 1, 2""")
def ml_01_device_set(spark, sf):
    fixes = fix(spark, sf).select("session", (F.col("seq") * 100_000_000).alias("t_ns"), "speed")
    s = training.device_set(relation(spark, sf, "d_imu"), fixes, "session", 20, 10)
    total = lambda c: F.aggregate(F.col("window")[c], F.lit(0.0), lambda t, x: t + x)
    return s.select("session", F.col("start").cast("long").alias("start"), r(total(0), 5).alias("ex"), r(total(2), 5).alias("ez"), r(total(3)).alias("gx"), "speed", F.col("stationary").cast("int").alias("stationary"))


@query(f"""WITH b AS (SELECT session, CASE WHEN count(*) FILTER (speed < CAST(0.5 AS DOUBLE)) >= 3 THEN avg(acc) FILTER (speed < CAST(0.5 AS DOUBLE)) ELSE median(acc) END AS o FROM {FIX} GROUP BY 1),
x AS (SELECT f.session, seq, acc - o AS a, bearing, CASE WHEN event_id % 19 > 0 THEN speed END AS speed, CAST(used AS DOUBLE) AS yaw FROM {FIX} f JOIN b ON b.session = f.session)
SELECT s.session, s.seq AS start, round(sum(x.a), 4) AS a, round(sum(x.bearing), 4) AS g, max(l.speed) AS speed, max(l.yaw) AS yaw_rate FROM x s JOIN x ON x.session = s.session AND x.seq BETWEEN s.seq AND s.seq + 19 JOIN x l ON l.session = s.session AND l.seq = s.seq + 19
 JOIN (SELECT session, max(seq) AS m FROM x GROUP BY 1) c ON c.session = s.session WHERE s.seq % 10 = 0 AND s.seq < m + 1 - 20 AND l.speed IS NOT NULL GROUP BY 1, 2""")
def ml_02_run_set(spark, sf):
    b = training.run_biases(fix(spark, sf), "session", ["acc", "bearing"], "speed", 3).select("session", "b0")
    f = fix(spark, sf).join(b, "session").withColumn("a", F.col("acc") - F.col("b0"))  # the offset of whole speeds: some are taken away below
    f = f.withColumns({"speed": F.when(F.col("event_id") % 19 > 0, F.col("speed")), "yaw_rate": F.col("used").cast("double"), "lateral": F.lit(None).cast("double")})
    s = training.run_set(f, "session", "seq", ["a"], ["bearing"], "none", 20, 10)
    total = lambda c: r(F.aggregate(F.col("window")[c], F.lit(0.0), lambda t, x: t + x), 4)
    return s.select("session", F.col("start").cast("long").alias("start"), total(0).alias("a"), total(1).alias("g"), "speed", "yaw_rate")


@query(f"""WITH f AS (SELECT session, seq, speed, CASE WHEN event_id % 7 > 0 THEN acc END AS acc FROM {FIX}), y AS (SELECT f.*, coalesce(acc, avg(acc) OVER (PARTITION BY f.session)) AS a, coalesce(yaw, 0) AS yaw FROM f LEFT JOIN {_YAW} z ON z.session = f.session AND z.seq = f.seq)
SELECT s.session, s.seq AS start, round(sum(y.a), 4) AS a, max(l.speed) AS speed, CAST(max(l.speed) < CAST(0.2 AS DOUBLE) AS INTEGER) AS stationary, round(max(l.yaw), 5) AS yaw_rate,
 round(max(CASE WHEN l.speed >= CAST(0.2 AS DOUBLE) AND abs(l.yaw) > CAST(0.01 AS DOUBLE) THEN least(greatest(l.speed * l.yaw, -5), 5) ELSE 0 END), 4) AS lateral
 FROM y s JOIN y ON y.session = s.session AND y.seq BETWEEN s.seq AND s.seq + 9 JOIN y l ON l.session = s.session AND l.seq = s.seq + 10 WHERE s.seq % 5 = 0 GROUP BY 1, 2""")
def ml_03_phone_set(spark, sf):
    f = fix(spark, sf).withColumn("acc", F.when(F.col("event_id") % 7 > 0, F.col("acc")))
    s = training.phone_set(f, "session", "seq", "t_s", ["acc", "speed"], 10, 5)
    total = F.aggregate(F.col("window")[0], F.lit(0.0), lambda t, x: t + x)
    return s.select("session", F.col("start").cast("long").alias("start"), r(total, 4).alias("a"), "speed", F.col("stationary").cast("int").alias("stationary"), r("yaw_rate", 5).alias("yaw_rate"), r("lateral", 4).alias("lateral"))


@query()
def ml_05_greedy_split(spark, sf):
    sizes = [(str(x["run"]), x["n"]) for x in pred(spark, sf).groupBy("run").agg(F.count("*").alias("n")).collect()]  # one row for each run
    return spark.createDataFrame(sorted(training.greedy_split(sizes, ("3", "5")).items()), "run string, split string")


@query()
def ml_08_augmented(spark, sf):
    g = fix(spark, sf).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "speed", "acc"))).alias("s"))
    g = g.select("session", F.transform("s", lambda v: v["speed"]).alias("x"), F.transform("s", lambda v: v["acc"]).alias("y"))
    return learning.augmented(g, "session")


@query("SELECT 253 AS field, 29 AS small")
def ml_14_receptive_fields(spark, sf):
    from wayfold.operators.tcn import Geometry

    def names(blocks):
        return {"stem.0.weight": (48, 6, 7)} | {f"blocks.{i}.conv{k}.weight": (96, 96, 3) for i in range(blocks) for k in (1, 2)}

    return spark.createDataFrame([(Geometry.of(names(6)).receptive_field(), Geometry.of(names(3)).receptive_field())], "field int, small int")


_TERMS = ("displacement", "stationary", "physics", "yaw", "smoothness", "nhc", "total")


@query(f"""WITH c AS (SELECT *, seq // 10 AS g, session % 10 AS batch FROM {CHAN}),
w AS (SELECT batch, session, g, avg(model_speed) AS mu, least(4, greatest(-6, avg(yaw) * 20)) AS lv, avg(speed) AS y, 1 + max(session) % 3 AS wt, avg(speed) - 7 AS z, avg(speed) < 6 AS st, avg(model_yaw) AS yr, CASE WHEN avg(speed) >= 5 THEN avg(yaw) END AS ty, min(t_s) / 7 AS t0 FROM c GROUP BY 1, 2, 3),
p AS (SELECT batch, CASE WHEN sum(CAST(st AS INTEGER)) > 0 THEN sum(1 - CAST(st AS INTEGER)) / CAST(sum(CAST(st AS INTEGER)) AS DOUBLE) ELSE 1 END AS pw FROM w GROUP BY 1),
s AS (SELECT *, mu - lag(mu) OVER o AS dm, t0 - lag(t0) OVER o AS dt FROM w WINDOW o AS (PARTITION BY session ORDER BY g)),
a AS (SELECT batch, sum((lv / 2 + pow(y - mu, 2) / exp(lv) / 2) * wt) / sum(wt) AS displacement, avg(CASE WHEN st THEN pw * ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END) AS stationary, coalesce(avg(abs(yr - ty)), 0) AS yaw, coalesce(avg(abs(dm)) FILTER (dt > 0 AND dt <= CAST(1.5 AS DOUBLE)), 0) AS smoothness FROM s JOIN p USING (batch) GROUP BY 1),
f AS (SELECT batch, avg(pow(model_speed - v0 - a0, 2)) AS physics FROM (SELECT batch, model_speed, lag(model_speed) OVER o AS v0, lag(yaw) OVER o AS a0 FROM c WINDOW o AS (PARTITION BY session, g ORDER BY seq)) GROUP BY 1),
n AS (SELECT batch, avg(pow(mu * sin(h), 2)) AS nhc FROM (SELECT c.batch, w.mu, sum(gyro_yaw) OVER (PARTITION BY c.session, c.g ORDER BY seq ROWS UNBOUNDED PRECEDING) / 10 AS h FROM c JOIN w ON w.session = c.session AND w.g = c.g) GROUP BY 1)
SELECT batch, round(displacement, 5) AS displacement, round(stationary, 5) AS stationary, round(coalesce(physics, 0), 5) AS physics, round(yaw, 5) AS yaw, round(smoothness, 5) AS smoothness, round(nhc, 5) AS nhc,
 round(displacement + stationary / 2 + coalesce(physics, 0) * CAST(0.3 AS DOUBLE) + yaw / 5 + smoothness / 10 + nhc / 20, 5) AS total FROM a JOIN f USING (batch) JOIN n USING (batch)""")
def ml_09_multitask(spark, sf):
    c = relation(spark, sf, "d_chan").withColumns({"g": F.floor(F.col("seq") / 10).cast("long"), "batch": F.col("session") % 10})
    rows = F.array_sort(F.collect_list(F.struct("seq", "model_speed", "yaw", "gyro_yaw")))
    w = c.groupBy("batch", "session", "g").agg(*(F.avg(x).alias(x) for x in ("model_speed", "speed", "model_yaw", "yaw")), F.min("t_s").alias("t"), rows.alias("rows"))
    pick = lambda x, k=1.0: F.transform("rows", lambda q: q[x] * k)
    w = w.select(
        "batch", "session", "g", F.col("model_speed").alias("mu"), (F.col("yaw") * 20).alias("logvar"), F.col("speed").alias("displacement"), (1 + F.col("session") % 3).cast("double").alias("weight"), (F.col("speed") - 7).alias("logit"), (F.col("speed") < 6).alias("stationary"),
        F.col("model_yaw").alias("yaw_rate"), F.when(F.col("speed") >= 5, F.col("yaw")).otherwise(F.lit(float("nan"))).alias("true_yaw"), (F.col("t") / 7).alias("t0"), pick("model_speed").alias("v_seq"), pick("yaw", 10.0).alias("a_seq"), pick("gyro_yaw").alias("gyro_yaw"),
    )
    return losses.multitask(w, "batch", "session", "g", "t0").select("batch", *(r(x, 5).alias(x) for x in _TERMS))


# scores

def _track(spark, sf):
    """Channels with the truth's way summed up from its speed and heading."""
    w = training.by("session", "seq").rowsBetween(Window.unboundedPreceding, 0)
    c = relation(spark, sf, "d_chan").withColumn("heading", F.col("bearing"))
    return c.withColumns({"east": F.sum(F.col("speed") * F.sin(F.radians("heading"))).over(w) * 0.1, "north": F.sum(F.col("speed") * F.cos(F.radians("heading"))).over(w) * 0.1})


_TRACK = f"(SELECT *, bearing AS heading, sum(speed * sin(radians(bearing))) {UPTO} / 10 AS east, sum(speed * cos(radians(bearing))) {UPTO} / 10 AS north FROM {CHAN})"
_TURN = "radians(h0) + sum(sgn * {}) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) / 10"


@query(f"""WITH t AS (SELECT *, first_value(bearing) {W} AS h0, east - first_value(east) {W} AS te, north - first_value(north) {W} AS tn FROM {_TRACK}),
a AS (SELECT *, radians(heading) AS th_heading, {_TURN.format("yaw")} AS th_truth, {_TURN.format("gyro_yaw")} AS th_gyro, {_TURN.format("model_yaw")} AS th_model FROM t),
c AS (SELECT session, seq, heading, te, tn, speed, 'truth' AS speeds, 'heading' AS turns, speed AS v, th_heading AS th FROM a UNION ALL SELECT session, seq, heading, te, tn, speed, 'truth', 'truth', speed, th_truth FROM a UNION ALL SELECT session, seq, heading, te, tn, speed, 'truth', 'gyro', speed, th_gyro FROM a
 UNION ALL SELECT session, seq, heading, te, tn, speed, 'truth', 'model', speed, th_model FROM a UNION ALL SELECT session, seq, heading, te, tn, speed, 'model', 'truth', model_speed, th_truth FROM a UNION ALL SELECT session, seq, heading, te, tn, speed, 'model', 'gyro', model_speed, th_gyro FROM a UNION ALL SELECT session, seq, heading, te, tn, speed, 'model', 'model', model_speed, th_model FROM a),
x AS (SELECT *, sqrt(pow(sum(v * sin(th)) OVER p / 10 - te, 2) + pow(sum(v * cos(th)) OVER p / 10 - tn, 2)) AS e FROM c WINDOW p AS (PARTITION BY session, speeds, turns ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT session, speeds, turns, round(last(e ORDER BY seq), 4) AS final, round(max(e), 4) AS most, round(sum(abs(speed)) / 10, 4) AS distance, round(100 * last(e ORDER BY seq) / (sum(abs(speed)) / 10), 3) AS percent FROM x GROUP BY 1, 2, 3""")
def ml_18_swapped_channels(spark, sf):
    s = training.swapped_channels(_track(spark, sf), ["session"], "seq", "sgn")
    return s.select("session", "speeds", "turns", r("final", 4).alias("final"), r("most", 4).alias("most"), r("distance", 4).alias("distance"), r("percent", 3).alias("percent"))


@query(f"""WITH t AS {_TRACK}, n AS (SELECT session, count(*) AS n FROM t GROUP BY 1), s AS (SELECT t.session, t.seq AS start, t.heading AS h0, t.east AS e0, t.north AS n0 FROM t JOIN n USING (session) WHERE t.seq % 12 = 0 AND t.seq + 10 < n),
c AS (SELECT s.session, s.start, avg(b.speed - b.model_speed) AS o, avg(b.gyro_yaw - b.yaw) AS g FROM s JOIN t b ON b.session = s.session AND b.seq BETWEEN s.start - 30 AND s.start - 1 GROUP BY 1, 2 HAVING count(*) >= 15),
a AS (SELECT s.session, s.start, x.seq, x.speed, x.model_speed + o AS v, x.east - e0 AS te, x.north - n0 AS tn, radians(h0) + sum(x.sgn * (x.gyro_yaw - g)) OVER (PARTITION BY s.session, s.start ORDER BY x.seq ROWS UNBOUNDED PRECEDING) / 10 AS th FROM s JOIN c USING (session, start) JOIN t x ON x.session = s.session AND x.seq BETWEEN s.start AND s.start + 9),
p AS (SELECT *, sum(v * sin(th)) OVER q / 10 - te AS de, sum(v * cos(th)) OVER q / 10 - tn AS dn FROM a WINDOW q AS (PARTITION BY session, start ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT session, start, round(100 * sqrt(pow(last(de ORDER BY seq), 2) + pow(last(dn ORDER BY seq), 2)) / (sum(speed) / 10), 3) AS percent FROM p GROUP BY 1, 2 HAVING sum(speed) / 10 > 5""")
def ml_19_checkpoint_drift(spark, sf):
    s = training.checkpoint_drift(_track(spark, sf), "session", "seq", "sgn", 10, 12, 30, 15, 5.0)
    return s.select("session", F.col("start").cast("long").alias("start"), r("percent", 3).alias("percent"))


@query(f"""WITH t AS (SELECT *, speed > 1 AS drive FROM {_TRACK}), m AS (SELECT session, seq, drive, speed, heading, east, north, 'ours' AS model, model_speed AS v FROM t UNION ALL SELECT session, seq, drive, speed, heading, east, north, 'theirs', speed * CAST(0.5 AS DOUBLE) + 3 FROM t),
k AS (SELECT session, model, round(sqrt(avg(pow(v - speed, 2))), 4) AS rmse, round(avg(v - speed), 4) AS bias, round(100 * (1 - sqrt(avg(pow(v - speed, 2))) / stddev_pop(speed)), 3) AS gain FROM m WHERE drive GROUP BY 1, 2),
n AS (SELECT session, count(*) AS n FROM t GROUP BY 1), s AS (SELECT m.session, model, seq AS start, east AS e0, north AS n0 FROM m JOIN n USING (session) WHERE seq % 10 = 0 AND seq + 4 < n),
w AS (SELECT s.session, s.model, s.start, sqrt(pow(sum(v * sin(radians(heading))) / 10 - (last(east ORDER BY seq) - max(e0)), 2) + pow(sum(v * cos(radians(heading))) / 10 - (last(north ORDER BY seq) - max(n0)), 2)) AS x, sum(speed) / 10 AS d, min(drive) AS allway FROM s JOIN m ON m.session = s.session AND m.model = s.model AND m.seq BETWEEN s.start AND s.start + 3 GROUP BY 1, 2, 3)
SELECT k.session, k.model, rmse, bias, gain, drift FROM k LEFT JOIN (SELECT session, model, round(median(100 * x / d), 3) AS drift FROM w WHERE allway AND d >= 1 GROUP BY 1, 2) z ON z.session = k.session AND z.model = k.model""")
def ml_20_compared_models(spark, sf):
    t = _track(spark, sf).withColumns({"drive": F.col("speed") > 1, "other": F.col("speed") * 0.5 + 3})
    s = training.compared_models(t, "session", "seq", {"ours": "model_speed", "theirs": "other"}, 4, 10, 1.0)
    return s.select("session", "model", r("rmse", 4).alias("rmse"), r("bias", 4).alias("bias"), r("gain", 3).alias("gain"), r("drift", 3).alias("drift"))


@query(f"""SELECT session, frame, label, n, CASE WHEN n >= 10 THEN round(e, 4) END AS rmse, CASE WHEN n >= 10 THEN round(100 * (1 - e / nullif(s, 0)), 3) END AS gain FROM (SELECT session, frame, label, count(*) AS n, sqrt(avg(pow(p - t, 2))) AS e, stddev_pop(t) AS s FROM
 (SELECT session, CASE WHEN seq % 3 = 0 THEN 'earth' ELSE 'vehicle' END AS frame, 'speed' AS label, model_speed AS p, speed AS t FROM {CHAN} UNION ALL SELECT session, CASE WHEN seq % 3 = 0 THEN 'earth' ELSE 'vehicle' END, 'yaw', model_yaw, gyro_yaw FROM {CHAN}) GROUP BY 1, 2, 3)""")
def ml_22_replay_report(spark, sf):
    c = relation(spark, sf, "d_chan").withColumn("frame", F.when(F.col("seq") % 3 == 0, "earth").otherwise("vehicle"))
    s = training.replay_report(c, "session", "frame", {"speed": ("model_speed", "speed"), "yaw": ("model_yaw", "gyro_yaw")})
    return s.select("session", "frame", "label", "n", r("rmse", 4).alias("rmse"), r("gain", 3).alias("gain"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
