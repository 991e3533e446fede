"""Queries of roads by tile, walks, replays and recomputed sessions. SQL, where there is any, is written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import corridor, gnss, graph, reports, spatial, tcn, windows
from wayfold.plans.fixtures import oracle, relation
from wayfold.plans.series_queries import fix, r
from wayfold.streaming import folds, tracking

_QUERIES, _SQL = {}, {}


def query(sql=None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


FIX, SEG, CHAN = (f"({oracle(n)})" for n in ("d_fix", "d_seg", "d_chan"))
W = "OVER (PARTITION BY session ORDER BY seq)"


def _tx(lon: str, zoom: int = 15) -> str:
    return f"CAST(floor(({lon} + 180) / 360 * {1 << zoom}) AS BIGINT)"


def _ty(lat: str, zoom: int = 15) -> str:
    return f"CAST(floor((1 - asinh(tan(radians({lat}))) / pi()) / 2 * {1 << zoom}) AS BIGINT)"


def seg(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "d_seg")


# roads by tile

_T = "greatest(0, least(1, ((lon - alon) * k * (blon - alon) * k + (lat - alat) * 111132 * (blat - alat) * 111132) / (pow((blon - alon) * k, 2) + pow((blat - alat) * 111132, 2))))"


@query(f"""WITH p AS (SELECT session, seq, lat, lon, {_tx("lon")} AS tx, {_ty("lat")} AS ty, 111132 * cos(radians(lat)) AS k FROM {FIX}),
s AS (SELECT *, {_tx("alon")} AS ax, {_ty("alat")} AS ay, {_tx("blon")} AS bx, {_ty("blat")} AS by_ FROM {SEG}),
x AS (SELECT session, seq, seg_id, lat, lon, k, alat, alon, blat, blon, {_T} AS t FROM p JOIN s ON abs(alat - lat) < CAST(0.01 AS DOUBLE) AND abs(alon - lon) < CAST(0.01 AS DOUBLE) WHERE (abs(tx - ax) <= 1 AND abs(ty - ay) <= 1) OR (abs(tx - bx) <= 1 AND abs(ty - by_) <= 1)),
y AS (SELECT session, seq, seg_id, sqrt(pow((alat + (blat - alat) * t - lat) * 111132, 2) + pow((alon + (blon - alon) * t - lon) * 111132 * cos(radians((lat + alat + (blat - alat) * t) / 2)), 2)) AS dist FROM x)
SELECT session, seq, seg_id, round(dist, 3) AS dist FROM y WHERE dist <= 60""")
def jn_11_tile_candidates(spark, sf):
    c = corridor.tile_candidates(fix(spark, sf), seg(spark, sf), ["session", "seq"], 60.0)
    return c.select("session", "seq", "seg_id", r("dist", 3).alias("dist"))


_NEAR = f"""(WITH p AS (SELECT session, seq, lat, lon, bearing, 111132 * cos(radians(lat)) AS k FROM {FIX}), s AS (SELECT seg_id, alat, alon, blat, blon FROM {SEG}),
x AS (SELECT session, seq, seg_id, lat, lon, bearing, alat, alon, blat, blon, alat + (blat - alat) * {_T} AS slat, alon + (blon - alon) * {_T} AS slon FROM p JOIN s ON abs(alat - lat) < CAST(0.004 AS DOUBLE) AND abs(alon - lon) < CAST(0.004 AS DOUBLE)),
y AS (SELECT *, sqrt(pow((slat - lat) * 111132, 2) + pow((slon - lon) * 111132 * cos(radians((lat + slat) / 2)), 2)) AS dist FROM x),
z AS (SELECT *, round(-pow(dist / 30, 2) / 2 - pow(degrees(asin(abs(sin(radians(bearing) - atan2((blon - alon) * cos(radians(alat) / 2 + radians(blat) / 2), blat - alat))))) / 35, 2) / 2, 9) AS score FROM y WHERE dist <= 120)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY score DESC, seg_id) AS place FROM z) WHERE place <= 12)"""


def _beam(spark, sf) -> DataFrame:
    """The twelve best states of each fix by distance and heading alone."""
    c = spatial.candidates(fix(spark, sf), seg(spark, sf), ["session", "seq"], 120.0, most=None).join(fix(spark, sf).select("session", "seq", "bearing"), ["session", "seq"])
    off = F.expr(geo.undirected_difference("bearing", geo.bearing("alat", "alon", "blat", "blon")))
    c = c.withColumns({"slat": F.expr(geo.along("alat", "blat", "t")), "slon": F.expr(geo.along("alon", "blon", "t")), "score": F.round(-F.pow(F.col("dist") / 30, F.lit(2)) / 2 - F.pow(off / 35, F.lit(2)) / 2, 9)})
    w = Window.partitionBy("session", "seq").orderBy(F.desc("score"), "seg_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 12")


@query(f"SELECT session, seq, seg_id, round(score, 5) + 0 AS score, CAST(place AS BIGINT) AS place FROM {_NEAR}")
def srt_02_beam(spark, sf):
    return _beam(spark, sf).select("session", "seq", "seg_id", r("score", 5).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"""WITH n AS {_NEAR}, w AS (SELECT a.session, a.seq, a.seg_id, b.score - pow((sqrt(pow((a.slat - b.slat) * 111132, 2) + pow((a.slon - b.slon) * 111132 * cos(radians((a.slat + b.slat) / 2)), 2)) - sqrt(pow((a.lat - b.lat) * 111132, 2) + pow((a.lon - b.lon) * 111132 * cos(radians((a.lat + b.lat) / 2)), 2))) / 25, 2) / 2 + CASE WHEN a.seg_id = b.seg_id THEN 1 ELSE 0 END AS way FROM n a JOIN n b ON a.session = b.session AND a.seq = b.seq + 1)
SELECT session, seq, seg_id, round(score + coalesce(max(way), 0), 4) AS best FROM n LEFT JOIN w USING (session, seq, seg_id) GROUP BY session, seq, seg_id, score""")
def jn_14_transitions(spark, sf):
    return spatial.transitions(_beam(spark, sf), "session", "seq").withColumn("best", r("best", 4))


_REQ = "(SELECT n_nationkey AS req, CAST(22.3 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (n_nationkey % 5) AS alat, CAST(87.3 AS DOUBLE) AS alon, CAST(22.3 AS DOUBLE) + CAST(0.03 AS DOUBLE) * n_nationkey AS blat, CAST(87.31 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (n_nationkey % 3) AS blon FROM nation)"


@query(f"""WITH q AS (SELECT *, 12742000 * asin(sqrt(pow(sin(radians(blat - alat) / 2), 2) + cos(radians(alat)) * cos(radians(blat)) * pow(sin(radians(blon - alon) / 2), 2))) AS m FROM {_REQ}),
b AS (SELECT *, CASE WHEN m < 10000 THEN 15 WHEN m < 50000 THEN 14 ELSE 13 END AS z, CASE WHEN m < 10000 THEN 3000 WHEN m < 50000 THEN 8000 WHEN m < 150000 THEN 15000 ELSE 20000 END AS d FROM q),
c AS (SELECT *, least(alat, blat) - d / 111132.0 AS s, greatest(alat, blat) + d / 111132.0 AS n, least(alon, blon) - d / (111132 * cos(radians((alat + blat) / 2))) AS w, greatest(alon, blon) + d / (111132 * cos(radians((alat + blat) / 2))) AS e FROM b),
t AS (SELECT seg_id, cls, lat, lon FROM (SELECT seg_id, cls, alat AS lat, alon AS lon FROM {SEG} UNION ALL SELECT seg_id, cls, blat, blon FROM {SEG}) WHERE cls <> 'footway'),
v AS (SELECT req, seg_id FROM c JOIN t ON floor((lon + 180) / 360 * (1 << z)) BETWEEN floor((w + 180) / 360 * (1 << z)) AND floor((e + 180) / 360 * (1 << z)) AND floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * (1 << z)) BETWEEN floor((1 - asinh(tan(radians(n))) / pi()) / 2 * (1 << z)) AND floor((1 - asinh(tan(radians(s))) / pi()) / 2 * (1 << z)) WHERE z = 15 OR cls = 'primary'
 UNION SELECT req, seg_id FROM (SELECT req, alat AS plat, alon AS plon FROM c WHERE z < 15 UNION ALL SELECT req, blat, blon FROM c WHERE z < 15) JOIN t ON abs({_tx("lon")} - {_tx("plon")}) <= 3 AND abs({_ty("lat")} - {_ty("plat")}) <= 3)
SELECT req, seg_id FROM v""")
def jn_15_corridors(spark, sf):
    q = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey AS req", "22.3D + 0.001D * (n_nationkey % 5) AS alat", "87.3D AS alon", "22.3D + 0.03D * n_nationkey AS blat", "87.31D + 0.01D * (n_nationkey % 3) AS blon")
    return corridor.corridors(q, seg(spark, sf))


@query(f"""WITH RECURSIVE b AS (SELECT session AS id, min(lat) AS s, min(lon) AS w, max(lat) + CAST(0.01 AS DOUBLE) AS n, max(lon) + CAST(0.02 AS DOUBLE) AS e FROM {FIX} GROUP BY 1),
h AS (SELECT id, s, w, n, e FROM b UNION ALL SELECT id, CASE WHEN n - s >= e - w THEN s + k * (n - s) / 2 ELSE s END, CASE WHEN n - s >= e - w THEN w ELSE w + k * (e - w) / 2 END, CASE WHEN n - s >= e - w THEN s + (k + 1) * (n - s) / 2 ELSE n END, CASE WHEN n - s >= e - w THEN e ELSE w + (k + 1) * (e - w) / 2 END FROM h, (SELECT 0 AS k UNION ALL SELECT 1) x WHERE (n - s) * (e - w) > CAST(0.0001 AS DOUBLE))
SELECT id, round(s, 7) AS south, round(w, 7) AS west, round(n, 7) AS north, round(e, 7) AS east FROM h WHERE (n - s) * (e - w) <= CAST(0.0001 AS DOUBLE)""")
def set_05_halved_boxes(spark, sf):
    b = fix(spark, sf).groupBy(F.col("session").alias("id")).agg(F.min("lat").alias("south"), F.min("lon").alias("west"), (F.max("lat") + 0.01).alias("north"), (F.max("lon") + 0.02).alias("east"))
    return corridor.halved(b, 0.0001).select("id", *(r(c, 7).alias(c) for c in ("south", "west", "north", "east")))


@query(f"""WITH c AS (SELECT DISTINCT session, CAST(floor(lat / CAST(0.002 AS DOUBLE)) AS BIGINT) AS i, CAST(floor(lon / CAST(0.002 AS DOUBLE)) AS BIGINT) AS j FROM {FIX}),
g AS (SELECT session, i, min(j) AS j0, max(j) AS j1 FROM (SELECT *, j - row_number() OVER (PARTITION BY session, i ORDER BY j) AS g FROM c) GROUP BY session, i, g),
s AS (SELECT session, j0, j1, min(i) AS i0, max(i) AS i1 FROM (SELECT *, i - row_number() OVER (PARTITION BY session, j0, j1 ORDER BY i) AS g FROM g) GROUP BY session, j0, j1, g)
SELECT session, round(i0 * CAST(0.002 AS DOUBLE) - CAST(0.0005 AS DOUBLE), 6) AS south, round(j0 * CAST(0.002 AS DOUBLE) - CAST(0.0005 AS DOUBLE), 6) AS west, round((i1 + 1) * CAST(0.002 AS DOUBLE) + CAST(0.0005 AS DOUBLE), 6) AS north, round((j1 + 1) * CAST(0.002 AS DOUBLE) + CAST(0.0005 AS DOUBLE), 6) AS east FROM s""")
def gr_08_planned_boxes(spark, sf):
    b = corridor.planned_boxes(fix(spark, sf), "session", 0.002, 0.0005, 1.0)
    return b.select("session", *(r(c, 6).alias(c) for c in ("south", "west", "north", "east")))


def _blocks(spark, sf) -> DataFrame:
    """Each z15 tile with the roads of its eight neighbours."""
    s = seg(spark, sf).withColumns({"tx": F.expr(geo.tile_x("alon", 15)), "ty": F.expr(geo.tile_y("alat", 15))})
    return s.withColumn("block", F.explode(F.expr("flatten(transform(array(-1, 0, 1), x -> transform(array(-1, 0, 1), y -> concat_ws('/', tx + x, ty + y))))")))


def _own(spark, sf) -> DataFrame:
    return seg(spark, sf).select("seg_id", F.concat_ws("/", F.expr(geo.tile_x("alon", 15)), F.expr(geo.tile_y("alat", 15))).alias("block"))


_Q = "(CAST(0.5 AS DOUBLE) / 111132)"


@query(f"SELECT seg_id, 0 AS side, CAST(floor(alat / {_Q} + CAST(0.5 AS DOUBLE)) AS BIGINT) || ':' || CAST(floor(alon / {_Q} + CAST(0.5 AS DOUBLE)) AS BIGINT) AS node FROM {SEG} UNION ALL SELECT seg_id, 1, CAST(floor(blat / {_Q} + CAST(0.5 AS DOUBLE)) AS BIGINT) || ':' || CAST(floor(blon / {_Q} + CAST(0.5 AS DOUBLE)) AS BIGINT) FROM {SEG}")
def gr_01_topology(spark, sf):
    return spatial.topology(seg(spark, sf))


@query(f"SELECT {_tx('alon')} || '/' || {_ty('alat')} AS tile, count(*) AS own FROM {SEG} GROUP BY 1")
def gr_09_tile_blocks(spark, sf):
    return _own(spark, sf).groupBy(F.col("block").alias("tile")).agg(F.count("*").alias("own"))


@query()
def gr_03_walks(spark, sf):
    q = _own(spark, sf).select("block", F.col("seg_id").alias("req"), F.col("seg_id").alias("seg"), F.lit(10.0).alias("off"), F.lit(1).alias("dir"), F.lit(250.0).alias("metres"))
    return graph.walks(q, _blocks(spark, sf), "block")


@query()
def gr_04_road_distances(spark, sf):
    q = _own(spark, sf).select("block", F.col("seg_id").alias("req"), F.col("seg_id").alias("sa"), F.lit(20.0).alias("oa"), (F.col("seg_id") + 5).alias("sb"), F.lit(30.0).alias("ob"))
    return graph.distances_between(q, _blocks(spark, sf), "block", 400.0)


@query()
def agg_13_disconnected_hops(spark, sf):
    n = _own(spark, sf).agg(F.max("seg_id").alias("most"))
    m = relation(spark, sf, "d_match").crossJoin(F.broadcast(n)).withColumn("seg", (F.col("seq") * 4 + F.col("session") * 6) % F.col("most"))
    hops = reports.match_hops(m, "session", "seq").where("seg_a <> seg_b")
    pairs = hops.select("seg_a", "seg_b").distinct().join(_own(spark, sf), F.col("seg_a") == F.col("seg_id")).drop("seg_id")
    reached = graph.reachable(pairs, _blocks(spark, sf), "block").select("seg_a", "seg_b", "reached")
    return hops.join(reached, ["seg_a", "seg_b"], "left").groupBy("session").agg(F.count("*").alias("pairs"), F.count(F.when(~F.coalesce("reached", F.lit(False)), 1)).alias("disconnected"))


# tracking

def _roads(spark, sf) -> DataFrame:
    """Roads of the 3 x 3 tiles around each session's fixes."""
    t = fix(spark, sf).select("session", F.expr(geo.tile_x("lon", 15)).alias("x"), F.expr(geo.tile_y("lat", 15)).alias("y")).distinct()
    t = t.select("session", F.explode(F.expr("sequence(x - 1, x + 1)")).alias("tx"), "y").select("session", "tx", F.explode(F.expr("sequence(y - 1, y + 1)")).alias("ty")).distinct()
    s = corridor.segment_tiles(seg(spark, sf)).select("seg_id", "tx", "ty")
    return t.join(s, ["tx", "ty"]).select("session", "seg_id").distinct().join(seg(spark, sf), "seg_id")


@query()
def st_04_04b_along_road(spark, sf):
    f = fix(spark, sf)
    e = f.select("session", (F.col("seq") * 1_000_000_000).alias("t_ns"), F.lit("tick").alias("kind"), "lat", "lon", F.col("bearing").alias("course"), (F.col("seq") % 40 >= 5).alias("unaided"), ((F.col("seq") % 40) * 20.0).alias("drift"), F.concat_ws("/", F.expr(geo.tile_x("lon", 15)), F.expr(geo.tile_y("lat", 15))).alias("block"))
    return folds.fold_on_roads(e, _roads(spark, sf), "session", tracking.along_road, "session long, t_ns long, lat double, lon double, seg long, heading double, correction double, confidence double")


@query()
def st_03b_route_matcher(spark, sf):
    f = fix(spark, sf)
    e = f.select("session", F.col("seq").alias("t_ns"), F.lit("fix").alias("kind"), "lat", "lon", F.col("bearing").alias("course"), "speed", (F.col("acc") + 30).alias("sigma"))

    def make(g):
        step = folds.matcher("eval", graph=g)
        return lambda s, x: step(s, x | {"near": g.near(x["lat"], x["lon"], min(60 + x["sigma"], 400.0))})

    return folds.fold_on_roads(e, _roads(spark, sf), "session", make, "session long, t_ns long, lat double, lon double, seg long, correction double, confidence double")


@query()
def st_12_recomputed(spark, sf):
    from wayfold.plans.state_queries import _imu_events

    model = fix(spark, sf).select("session", (F.col("seq") * 100_000_000 + 60_000_000).alias("t_ns"), F.lit("model").alias("kind"), F.col("speed").alias("mu"), F.lit(0.0).alias("logvar"), (F.col("used") - 6.0).alias("logit"))
    e = _imu_events(spark, sf).unionByName(model, allowMissingColumns=True)
    return folds.fold_on_roads(e, _roads(spark, sf), "session", lambda g: tracking.recompute(g, max_dt=0.2), "session long, t_ns long, track string, place long, lat double, lon double")


@query(f"SELECT session, seq, unaided, CASE WHEN unaided THEN CAST(seq - max(CASE WHEN NOT unaided THEN seq + 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) ELSE 0 END AS seconds FROM (SELECT session, seq, seq % 29 = 3 OR coalesce(seq - max(CASE WHEN used >= 4 THEN seq END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) > 5, true) AS unaided FROM {FIX})")
def st_15_mode_switch(spark, sf):
    f = fix(spark, sf)
    t = F.col("seq") * 1_000_000_000
    fixes = f.select("session", t.alias("t_ns"), F.lit(0).alias("row_seq"), F.lit("fix").alias("kind"), (F.col("used") >= 4).alias("healthy"))
    ticks = f.select("session", t.alias("t_ns"), F.lit(1).alias("row_seq"), F.lit("tick").alias("kind"), (F.col("seq") % 29 == 3).alias("forced"))
    out = folds.fold(fixes.unionByName(ticks, allowMissingColumns=True), "session", tracking.mode_switch, "session long, t_ns long, unaided boolean, seconds double")
    return out.select("session", (F.col("t_ns") / 1_000_000_000).cast("long").alias("seq"), "unaided", "seconds")


@query(f"""WITH a AS (SELECT session, seq, speed, CAST(event_id % 10 AS DOUBLE) / 10 AS c, (acc * 11 - bearing + 540) - 360 * floor((acc * 11 - bearing + 540) / 360) - 180 AS p, (acc * 11 + 180 - bearing + 540) - 360 * floor((acc * 11 + 180 - bearing + 540) / 360) - 180 AS q FROM {FIX}),
b AS (SELECT session, seq, CASE WHEN c >= CAST(0.6 AS DOUBLE) AND speed >= 2 THEN greatest(-4, least(4, CAST(0.35 AS DOUBLE) * CASE WHEN abs(p) <= abs(q) THEN p ELSE q END)) ELSE 0 END AS t FROM a)
SELECT session, seq, round(t, 5) AS applied, round(sum(t) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS total FROM b""")
def st_18_snaps(spark, sf):
    e = fix(spark, sf).select("session", F.col("seq").alias("t_ns"), F.lit("snap").alias("kind"), F.col("bearing").alias("course"), (F.col("acc") * 11).alias("road"), "speed", ((F.col("event_id") % 10) / 10).alias("confidence"))
    out = folds.fold(e, "session", tracking.snaps, "session long, t_ns long, applied double, total double")
    return out.select("session", F.col("t_ns").alias("seq"), r("applied", 5).alias("applied"), r("total", 4).alias("total"))


@query()
def st_13_back_pressure(spark, sf):
    e = fix(spark, sf).select("session", (F.col("seq") * 20_000_000).alias("t_ns"), F.lit("call").alias("kind"))
    return folds.fold(e, "session", lambda: tracking.back_pressure(0.04), "session long, t_ns long, pending int, dropped long")


@query(f"SELECT session, seq // 20 AS batch, count(*) AS n, round(avg(speed), 5) AS mean FROM {FIX} GROUP BY 1, 2 HAVING count(*) >= 20")
def st_14_training_batches(spark, sf):
    b = fix(spark, sf).groupBy("session", F.floor(F.col("seq") / 20).cast("long").alias("batch")).agg(F.count("*").alias("n"), r(F.avg("speed"), 5).alias("mean"))
    return b.where("n >= 20")


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT session, seq, CAST(used - 4 AS DOUBLE) / 10 AS turn, CASE WHEN event_id % 4 > 0 THEN bearing END AS c FROM {FIX}), h AS (SELECT session, seq, c AS deg FROM f WHERE seq = 0 UNION ALL
 SELECT session, seq, CASE WHEN deg IS NULL THEN c WHEN c IS NULL THEN p - 360 * floor(p / 360) ELSE q - 360 * floor(q / 360) END FROM (SELECT *, p + (c - p + 180 - 360 * floor((c - p + 180) / 360) - 180) / 81 AS q FROM (SELECT f.session, f.seq, c, deg, deg + turn AS p FROM h JOIN f ON f.session = h.session AND f.seq = h.seq + 1) x) y)
SELECT session, seq AS t_ns, round(deg, 6) AS heading FROM h WHERE deg IS NOT NULL""")
def st_05b_complementary(spark, sf):
    e = fix(spark, sf).select("session", F.col("seq").alias("t_ns"), F.lit("yaw").alias("kind"), F.radians(F.col("used") - 4).alias("rate"), F.lit(0.1).alias("dt"), F.when(F.col("event_id") % 4 > 0, F.col("bearing")).alias("compass"))
    return folds.fold(e, "session", tracking.complementary, "session long, t_ns long, heading double").withColumn("heading", r("heading"))


PLACES = "session long, t_ns long, lat double, lon double, speed double, heading double"


@query()
def st_10_kinematic(spark, sf):
    from wayfold.plans.state_queries import _imu_events

    start = fix(spark, sf).where("seq = 0").select("session", F.lit(-1).cast("long").alias("t_ns"), F.lit("start").alias("kind"), "lat", "lon", "speed", "bearing")
    return folds.fold(_imu_events(spark, sf).where("kind <> 'anchor'").unionByName(start, allowMissingColumns=True), "session", tracking.kinematic, PLACES)


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT session, seq, bearing, yaw AS w, speed AS gps, model_speed AS m, speed / 20 AS ae, model_speed / 30 AS an, yaw * 20 >= CAST(1.7 AS DOUBLE) AS told FROM {CHAN}),
h AS (SELECT session, seq, radians(bearing) AS h, gps AS v, CAST(1 AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS n FROM f WHERE seq = 0 UNION ALL
 SELECT session, seq, h, v, k, e + v * sin(h) / 10, n + v * cos(h) / 10 FROM (SELECT session, seq, h, k, e, n, CASE WHEN told OR (abs(w) < CAST(0.03 AS DOUBLE) AND sqrt(ae * ae + an * an) < CAST(0.25 AS DOUBLE) AND v < CAST(0.8 AS DOUBLE)) THEN 0 WHEN m > CAST(0.5 AS DOUBLE) THEN CAST(0.9 AS DOUBLE) * ahead + m / 10 ELSE ahead END AS v FROM
 (SELECT *, greatest(0, v + ((ae - w * v * cos(h)) * sin(h) + (an + w * v * sin(h)) * cos(h)) / 10 * k) AS ahead FROM
 (SELECT f.session, f.seq, h + w / 10 AS h, v, w, m, ae, an, told, e, n, CASE WHEN gps > CAST(3.5 AS DOUBLE) AND v > CAST(1.5 AS DOUBLE) THEN CAST(0.98 AS DOUBLE) * k + CAST(0.02 AS DOUBLE) * least(CAST(1.35 AS DOUBLE), greatest(CAST(0.75 AS DOUBLE), gps / v)) ELSE k END AS k FROM h JOIN f ON f.session = h.session AND f.seq = h.seq + 1) x) y) z)
SELECT session, seq AS t_ns, round(e, 6) + 0 AS east, round(n, 6) + 0 AS north, round(v, 6) + 0 AS speed FROM h""")
def st_09_adaptive(spark, sf):
    c = relation(spark, sf, "d_chan").select("session", F.col("seq").alias("t_ns"), F.lit("sample").alias("kind"), (-F.col("yaw")).alias("up"), (F.col("speed") / 20).alias("ae"), (F.col("model_speed") / 30).alias("an"), F.col("speed").alias("gps"), (F.col("yaw") * 20).alias("logit"), F.col("model_speed").alias("model"), "speed", "bearing")
    out = folds.fold(c, "session", tracking.adaptive, "session long, t_ns long, east double, north double, speed double")
    return out.select("session", "t_ns", r("east").alias("east"), r("north").alias("north"), r("speed").alias("speed"))


def _out(spark, sf) -> DataFrame:
    """Outputs of a network with drawn weights over windows of the channels."""
    c = relation(spark, sf, "d_chan")
    rows = c.withColumn("f", F.array("speed", "model_speed", "yaw", "model_yaw", "gyro_yaw", F.col("bearing") / 360))
    s = windows.sliding(rows, "session", "seq", "f", 20, 1)
    s = s.select("session", F.col("end").cast("long").alias("seq"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform("window", lambda x: F.get(x, k))).alias("window"))
    return tcn.infer(s, ["session", "seq"], "window", tcn.drawn_weights(3))


@query()
def ml_11_12_network(spark, sf):
    return _out(spark, sf).select("session", "seq", *(r(c, 6).alias(c) for c in tcn.OUTPUTS))


@query()
def st_11_replay(spark, sf):
    start = fix(spark, sf).where("seq = 0").select("session", F.lit(-1).cast("long").alias("t_ns"), F.lit("start").alias("kind"), "lat", "lon", "bearing")
    out = _out(spark, sf).join(relation(spark, sf, "d_chan").select("session", "seq", (-F.col("gyro_yaw")).alias("up")), ["session", "seq"])
    e = out.select("session", F.col("seq").alias("t_ns"), F.lit("out").alias("kind"), "mu", F.col("stationary_logit").alias("logit"), "up")
    return folds.fold(start.unionByName(e, allowMissingColumns=True), "session", tracking.replay, PLACES)


# satellites

@query()
def gn_04_sweep(spark, sf):
    t = fix(spark, sf).select("session", "seq", "t_s", "lat", "lon", "speed", "bearing")
    return gnss.sweep(t)


#: Satellite k on its circle in DuckDB, by sums and differences of the two angles; and the point on the ellipsoid.
_SAT = """(SELECT *, 26560000 * ((1 - c) / 2 * cos(u - o) + (1 + c) / 2 * cos(u + o)) AS sx, 26560000 * ((1 + c) / 2 * sin(u + o) - (1 - c) / 2 * sin(u - o)) AS sy, 26560000 * sin(u) * sqrt(1 - c * c) AS sz FROM
 (SELECT *, cos(radians(55)) AS c, radians(sat // 4 * 60) AS o, radians(sat % 4 * 90 + sat // 4 * 15) + 2 * pi() * t / 43082 AS u FROM {}, range(24) b(sat)))"""
_TIMES = f"(SELECT session, seq, lat, lon, t_s * 600 AS t FROM {FIX})"


@query(f"SELECT session, seq, sat, round(sx, 1) AS sx, round(sy, 1) AS sy, round(sz, 1) AS sz FROM {_SAT.format(_TIMES)}")
def gn_01_constellation(spark, sf):
    times = fix(spark, sf).select("session", "seq", (F.col("t_s") * 600).alias("t"))
    return gnss.constellation(spark, times).select("session", "seq", F.col("sat").cast("long").alias("sat"), *(r(c, 1).alias(c) for c in ("sx", "sy", "sz")))


@query(f"""WITH s AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz, 6378137 / sqrt(1 - (2 - 1 / CAST(298.257223563 AS DOUBLE)) / CAST(298.257223563 AS DOUBLE) * pow(sin(radians(lat)), 2)) AS n FROM {_SAT.format(_TIMES)}),
d AS (SELECT *, sx - n * ux AS dx, sy - n * uy AS dy, sz - n * pow(1 - 1 / CAST(298.257223563 AS DOUBLE), 2) * uz AS dz FROM s), e AS (SELECT session, seq, sat, 90 - degrees(acos((dx * ux + dy * uy + dz * uz) / sqrt(dx * dx + dy * dy + dz * dz))) AS elevation FROM d)
SELECT session, seq, sat, round(elevation, 4) AS elevation FROM e WHERE elevation >= 15""")
def gn_02_flt_13_visible(spark, sf):
    times = fix(spark, sf).select("session", "seq", "lat", "lon", (F.col("t_s") * 600).alias("t"))
    return gnss.visible(gnss.constellation(spark, times)).select("session", "seq", F.col("sat").cast("long").alias("sat"), r("elevation", 4).alias("elevation"))


@query(f"SELECT session, epoch, round(1 / sqrt(hh), 6) AS sigma FROM (SELECT session, seq - seq % 3 AS epoch, sum(pow(cos(radians(bearing) - atan2(CAST(0.6 AS DOUBLE), CAST(0.8 AS DOUBLE))), 2)) AS hh FROM {FIX} GROUP BY 1, 2) WHERE 1 / sqrt(hh) <= CAST(1.01 AS DOUBLE)")
def flt_14_covariance_gate(spark, sf):
    s = fix(spark, sf).select("session", (F.col("seq") - F.col("seq") % 3).alias("epoch"), F.sin(F.radians("bearing")).alias("le"), F.cos(F.radians("bearing")).alias("ln"), F.lit(0.6).alias("ue"), F.lit(0.8).alias("un"), F.col("speed").alias("rate"))
    return gnss.accepted(gnss.solve(s, ["session", "epoch"], "coast"), 1.01).select("session", "epoch", r("sigma").alias("sigma"))


@query(f"SELECT session, g, used, acc, CAST(k AS BIGINT) AS place FROM (SELECT session, seq // 9 AS g, used, acc, row_number() OVER (PARTITION BY session, seq // 9 ORDER BY acc DESC, used, seq) AS k FROM {FIX}) WHERE k <= 3")
def gn_05_highest(spark, sf):
    s = fix(spark, sf).select("session", F.floor(F.col("seq") / 9).cast("long").alias("g"), "used", "acc", F.col("acc").alias("elevation"), (F.col("used") * 10_000 + F.col("seq")).alias("sat"))
    w = Window.partitionBy("session", "g").orderBy(F.desc("acc"), "sat")
    return gnss.chosen(s, ["session", "g"], "elevation", 3).withColumn("place", F.row_number().over(w).cast("long")).select("session", "g", "used", "acc", "place")


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
