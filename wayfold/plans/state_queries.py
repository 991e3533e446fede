"""Queries of folds, graphs, satellites and learning operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import gnss, graph, learning, windows
from wayfold.plans.fixtures import relation
from wayfold.plans.series_queries import _NODES, FIX, PRED, SEG, W, fix, pred, r
from wayfold.streaming import folds

_QUERIES, _SQL = {}, {}


def query(sql=None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _imu_events(spark, sf):
    i = relation(spark, sf, "d_imu")
    rot = F.expr("CASE WHEN sensor = 'rv' THEN array(1 - 2 * v2 * v2, -2 * v2 * v3, 0D, 2 * v2 * v3, 1 - 2 * v2 * v2, 0D, 0D, 0D, 1D) END")
    events = i.select("session", "t_ns", F.col("seq").alias("row_seq"), F.when(F.col("sensor") == "rv", "rotation").otherwise(F.col("sensor")).alias("kind"), F.col("v0").alias("x"), F.col("v1").alias("y"), F.col("v2").alias("z"), rot.alias("r"))
    anchors = fix(spark, sf).where("seq % 40 = 0").select("session", (F.col("seq") * 100_000_000 - 1).alias("t_ns"), F.lit(-1).cast("long").alias("row_seq"), F.lit("anchor").alias("kind"), "lat", "lon", "speed", "bearing", "acc")
    return events.unionByName(anchors, allowMissingColumns=True)


TRACK = "session long, t_ns long, lat double, lon double, speed double, heading double, still boolean, drift double, sigma double"


def _steering(spark, sf):
    """Yaw rates, headings, the model's speed and stand-stills, and roads."""
    f, at = fix(spark, sf), lambda ns: (F.col("seq") * 100_000_000 + ns).alias("t_ns")
    yaw = f.where("event_id % 3 = 0").select("session", at(31_000_000), F.col("seq").alias("row_seq"), F.lit("yaw").alias("kind"), F.radians(F.col("used") - 4.0).alias("rate"), F.lit(0.1).alias("dt"))
    heading = f.where("event_id % 31 = 0").select("session", at(32_000_000), F.col("seq").alias("row_seq"), F.lit("heading").alias("kind"), F.col("bearing").alias("deg"))
    model = f.where("event_id % 5 = 0").select("session", at(61_000_000), F.col("seq").alias("row_seq"), F.lit("model").alias("kind"), "speed", F.lit(0.3).alias("weight"))
    still = f.where("event_id % 7 = 0").select("session", at(62_000_000), F.col("seq").alias("row_seq"), F.lit("still").alias("kind"), (F.col("used") < 2).alias("flag"))
    road = f.where("event_id % 4 = 0").select("session", at(63_000_000), F.col("seq").alias("row_seq"), F.lit("road").alias("kind"), (F.col("acc") * 11).alias("bearing"), F.lit(0.35).alias("gain"))
    out = yaw
    for part in (heading, model, still, road):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


@query()
def st_01_strapdown_live(spark, sf):
    return folds.fold(_imu_events(spark, sf).unionByName(_steering(spark, sf), allowMissingColumns=True), "session", lambda: folds.strapdown("live", max_dt=0.2), TRACK)


@query()
def st_02_strapdown_eval(spark, sf):
    return folds.fold(_imu_events(spark, sf), "session", lambda: folds.strapdown("eval", max_dt=0.2), TRACK)


@query()
def st_03_matcher(spark, sf):
    from wayfold.operators.spatial import candidates

    f = fix(spark, sf)
    seg = relation(spark, sf, "d_seg").withColumn("sb", F.expr(geo.bearing("alat", "alon", "blat", "blon")))
    c = candidates(f, seg, ["session", "seq"], 150.0)
    near = F.struct(F.col("seg_id").alias("seg"), F.expr(geo.along("alat", "blat", "t")).alias("lat"), F.expr(geo.along("alon", "blon", "t")).alias("lon"), "dist", F.col("sb").alias("bearing"), "oneway", "cls")
    near = c.groupBy("session", "seq").agg(F.collect_list(near).alias("near"))
    e = f.join(near, ["session", "seq"], "left").select("session", F.col("seq").alias("t_ns"), F.lit("fix").alias("kind"), "lat", "lon", F.col("bearing").alias("course"), "speed", (F.col("acc") + 10).alias("sigma"), F.lit(True).alias("force"), F.to_json("near").alias("near"))

    def make():
        import json

        step = folds.matcher("live")
        return lambda s, x: step(s, x | {"near": json.loads(x["near"] or "[]")})

    return folds.fold(e, "session", make, "session long, t_ns long, lat double, lon double, seg long, correction double, confidence double")


@query()
def st_05_compass(spark, sf):
    f = fix(spark, sf)
    fixes = f.select("session", (F.col("seq") * 10).alias("t_ns"), F.lit("fix").alias("kind"), "bearing", "speed", (F.col("acc") / 10).alias("turn"))
    yaw = f.select("session", (F.col("seq") * 10 + 5).alias("t_ns"), F.lit("yaw").alias("kind"), F.radians(F.col("used") - 4).alias("rate"), F.lit(0.1).alias("dt"))
    return folds.fold(fixes.unionByName(yaw, allowMissingColumns=True), "session", folds.compass, "session long, t_ns long, heading double, offset double, samples int")


@query()
def st_06_attitude(spark, sf):
    f = fix(spark, sf)
    e = f.select("session", F.col("seq").alias("t_ns"), F.lit("sample").alias("kind"), F.array(F.lit(0.0), F.lit(0.0), F.radians("used") / 10).alias("gyro"), F.array(F.col("speed") / 50, F.lit(0.1), F.lit(9.8)).alias("accel"), F.lit(0.1).alias("dt"))
    return folds.fold(e, "session", folds.attitude, "session long, t_ns long, heading double, up_x double, up_y double, up_z double, converged boolean")


@query(f"SELECT session, seq, round(((200 - sum(used) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) * CAST(0.1 AS DOUBLE)) % 360 + 360) % 360, 4) AS heading FROM {FIX}")
def st_07_tilt_yaw_heading(spark, sf):
    return fix(spark, sf).select("session", "seq", r(F.pmod(200 - windows.running("used", windows.by("session", "seq")) * 0.1, F.lit(360.0)), 4).alias("heading"))


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT session, seq, bearing FROM {FIX}), h AS (SELECT session, seq, bearing AS deg FROM f WHERE seq = 0 UNION ALL
 SELECT session, seq, g - 360 * floor(g / 360) FROM (SELECT f.session, f.seq, deg + CAST(0.35 AS DOUBLE) * (bearing - deg + 180 - 360 * floor((bearing - deg + 180) / 360) - 180) AS g FROM h JOIN f ON f.session = h.session AND f.seq = h.seq + 1) x)
SELECT session, seq AS t_ns, round(deg, 6) AS deg FROM h""")
def win_19_smoothed_circle(spark, sf):
    e = fix(spark, sf).select("session", F.col("seq").alias("t_ns"), F.lit("x").alias("kind"), F.col("bearing").alias("deg"))
    return folds.fold(e, "session", folds.smoothed_circle, "session long, t_ns long, deg double").withColumn("deg", r("deg"))


@query(f"SELECT session, seq, used < 3 AND seq - coalesce(last_good, -1000) > 5 AS unaided FROM (SELECT *, last_value(CASE WHEN used >= 3 THEN seq END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS last_good FROM {FIX})")
def flt_17_st_17_unaided(spark, sf):
    w = windows.by("session", "seq").rowsBetween(Window.unboundedPreceding, 0)
    good = F.last(F.when(F.col("used") >= 3, F.col("seq")), True).over(w)
    return fix(spark, sf).select("session", "seq", ((F.col("used") < 3) & (F.col("seq") - F.coalesce(good, F.lit(-1000)) > 5)).alias("unaided"))


@query()
def gr_06_components(spark, sf):
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp())
    return graph.road_components(relation(spark, sf, "d_seg"))


@query()
def gr_05_07_routes(spark, sf):
    # each z15 tile with its eight neighbours is a block; each segment asks for the last one of its own tile and the neighbours
    tile = lambda x, y: F.concat_ws("/", x, y)
    seg = relation(spark, sf, "d_seg").withColumns({"tx": F.expr(geo.tile_x("alon", 15)), "ty": F.expr(geo.tile_y("alat", 15))})
    near = F.explode(F.expr("flatten(transform(array(-1, 0, 1), x -> transform(array(-1, 0, 1), y -> concat_ws('/', tx + x, ty + y))))"))
    blocks = seg.withColumn("block", near)
    last = blocks.groupBy("block").agg(F.max("seg_id").alias("sb"))
    ask = seg.select(tile(F.col("tx"), F.col("ty")).alias("block"), F.col("seg_id").alias("req"), F.col("seg_id").alias("sa"), F.lit(10.0).alias("oa"), F.lit(20.0).alias("ob")).join(last, "block")
    return graph.routes(ask.select("block", "req", "sa", "oa", "sb", "ob"), blocks, "block")






_RATES = f"(SELECT session, seq - seq % 6 AS epoch, sin(radians(bearing)) AS le, cos(radians(bearing)) AS ln, CAST(0.6 AS DOUBLE) AS ue, CAST(0.8 AS DOUBLE) AS un, speed AS rate FROM {FIX})"
_H = "(le * ue + ln * un)"


@query(f"SELECT session, epoch, round(sum({_H} * rate) / nullif(sum({_H} * {_H}), 0), 5) AS coast, round((count(*) * sum({_H} * rate) - sum({_H}) * sum(rate)) / nullif(count(*) * sum({_H} * {_H}) - sum({_H}) * sum({_H}), 0), 3) AS nhc FROM {_RATES} GROUP BY 1, 2 HAVING count(*) = 6")
def gn_03_solve(spark, sf):
    s = fix(spark, sf).select("session", (F.col("seq") - F.col("seq") % 6).alias("epoch"), F.sin(F.radians("bearing")).alias("le"), F.cos(F.radians("bearing")).alias("ln"), F.lit(0.6).alias("ue"), F.lit(0.8).alias("un"), F.col("speed").alias("rate"))
    s = s.withColumn("c", F.count("*").over(Window.partitionBy("session", "epoch"))).where("c = 6")
    a, b = gnss.solve(s, ["session", "epoch"], "coast"), gnss.solve(s, ["session", "epoch"], "nhc")
    return a.select("session", "epoch", r("speed", 5).alias("coast")).join(b.select("session", "epoch", r("speed", 3).alias("nhc")), ["session", "epoch"])


@query()
def gn_03_solve_full(spark, sf):
    f = fix(spark, sf)
    s = f.select("session", (F.col("seq") - F.col("seq") % 8).alias("epoch"), F.sin(F.radians("bearing")).alias("le"), F.cos(F.radians("bearing")).alias("ln"), (F.col("acc") / 50).alias("lu"), F.col("speed").alias("rate"))
    return gnss.solve(s, ["session", "epoch"], "full")


@query(f"""WITH x AS (SELECT session, seq, speed - avg(speed) OVER (PARTITION BY session) AS a, acc - avg(acc) OVER (PARTITION BY session) AS b FROM {FIX}), c AS (SELECT x.session, x.seq - y.seq AS lag, sum(x.a * y.b) AS s FROM x JOIN x y ON y.session = x.session GROUP BY 1, 2),
n AS (SELECT session, count(*) AS n, sqrt(sum(a * a) * sum(b * b)) AS d FROM x GROUP BY 1) SELECT n.session, CASE WHEN max(n) < 16 THEN 0 ELSE arg_max(lag, s) END AS lag, CASE WHEN max(n) < 16 THEN 0 ELSE round(max(s) / max(d), 6) END AS peak FROM c JOIN n ON n.session = c.session GROUP BY 1""")
def sig_01_lags(spark, sf):
    return learning.lags(fix(spark, sf).select("session", "seq", "speed", "acc"), "session", "seq", "speed", "acc").withColumn("peak", r("peak"))


@query(f"""SELECT session, round(d0, 4) AS w0 FROM (SELECT session, (t0 * (s11 * s22 - s12 * s12) - s01 * (t1 * s22 - s12 * t2) + s02 * (t1 * s12 - s11 * t2)) / nullif(s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02), 0) AS d0 FROM
 (SELECT session, sum(speed * speed) AS s00, sum(speed * acc) AS s01, sum(speed * used) AS s02, sum(acc * acc) AS s11, sum(acc * used) AS s12, CAST(sum(used * used) AS DOUBLE) AS s22, sum(speed * bearing) AS t0, sum(acc * bearing) AS t1, sum(used * bearing) AS t2 FROM {FIX} GROUP BY 1))""")
def rot_13_frame_fit(spark, sf):
    f = fix(spark, sf).withColumn("used", F.col("used").cast("double"))
    return learning.frame_moments(f, "session", ("speed", "acc", "used"), "bearing").select("session", r("w0", 4).alias("w0"))


@query(f"SELECT run, size, CASE WHEN coalesce(sum(size) OVER (ORDER BY size DESC, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2 * sum(size) OVER () THEN 'val' ELSE 'train' END AS split FROM (SELECT run, count(*) AS size FROM {PRED} GROUP BY 1)")
def ml_06_split(spark, sf):
    return learning.split_by_run(pred(spark, sf).groupBy("run").agg(F.count("*").alias("size")), "run", "size")


@query(f"SELECT run, i, truth FROM {PRED} WHERE run IN (3, 5, 8)")
def ml_07_hold_out(spark, sf):
    return pred(spark, sf).where(F.col("run").isin(3, 5, 8)).select("run", "i", "truth")


@query(f"WITH x AS (SELECT run, i, truth > 45 AS fast FROM {PRED}), k AS (SELECT count(*) AS n, count(*) FILTER (fast) AS f FROM x) SELECT run, i, fast, unnest(range(1, CASE WHEN fast THEN CAST(least(3, greatest(1, ceil(3 * (n - f) / (7 * CAST(f AS DOUBLE))))) AS INTEGER) ELSE 1 END + 1)) AS copy FROM x, k")
def ml_04_upsampled(spark, sf):
    return learning.upsampled(pred(spark, sf).withColumn("fast", F.col("truth") > 45).select("run", "i", "fast"), "fast", "i")


@query(f"SELECT session, seq, speed - lag(speed) {W} AS dspeed, bearing - lag(bearing) {W} AS dbearing FROM {FIX}")
def ml_16_targets(spark, sf):
    w = windows.by("session", "seq")
    return fix(spark, sf).select("session", "seq", windows.step("speed", w).alias("dspeed"), windows.step("bearing", w).alias("dbearing"))


@query(f"SELECT max(abs(pred - truth)) AS worst, max(abs(pred - truth)) < 0.0001 AS ok FROM {PRED}")
def ml_15_export_check(spark, sf):
    e = F.max(F.abs(F.col("pred") - F.col("truth")))
    return pred(spark, sf).agg(e.alias("worst"), (e < 1e-4).alias("ok"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
