"""Queries of readers and writers: the texts they read are made from the derived relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.functions.scalars import run_reason
from wayfold.plans.fixtures import relation
from wayfold.plans.series_queries import FIX, IMU, SEG, fix, r
from wayfold.sources import readers, sinks

_QUERIES, _SQL = {}, {}


def query(sql=None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


@query("SELECT name, rank FROM (SELECT p_size AS name, p_partkey % 3 AS rank, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 3) AS k FROM part WHERE p_partkey % 4 > 0) WHERE k = 1")
def src_01_sessions(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").alias("name"), (F.col("p_partkey") % 3).alias("root_rank"), (F.col("p_partkey") % 4 > 0).alias("has_files"))
    return readers.sessions(p).select("name", F.col("root_rank").alias("rank"))


@query(f"SELECT session, t_ns, sensor, v0, v1, v2 FROM {IMU} WHERE sensor IN ('accel', 'gyro') AND seq % 5 > 0")
def src_02_03_imu(spark, sf):
    i = relation(spark, sf, "d_imu")
    text = F.concat_ws(",", F.when(F.col("seq") % 5 == 0, "broken").otherwise(F.col("t_ns").cast("string")), "sensor", F.lit("3"), *(F.col(f"v{k}").cast("string") for k in range(3)))
    return readers.parse_imu(i.select("session", text.alias("value")), ["accel", "gyro"]).select("session", "t_ns", "sensor", "v0", "v1", "v2")


@query(f"SELECT session, seq * 1000 AS t_ns, lat, lon, CASE WHEN seq % 4 > 0 THEN speed END AS speed_mps, acc AS acc_m, CASE WHEN acc > 20 THEN 'WEAK' ELSE 'GOOD' END AS quality FROM {FIX}")
def src_04_05_fixes(spark, sf):
    f = fix(spark, sf)
    text = F.concat_ws(",", (F.col("seq") * 1000).cast("string"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.when(F.col("seq") % 4 > 0, F.col("speed").cast("string")).otherwise(""), F.col("acc").cast("string"))
    out = readers.parse_fixes(f.select("session", text.alias("value")), ["t_ns", "Latitude", "longitude", "Speed", "acc_m"])
    return out.select("session", "t_ns", "lat", "lon", "speed_mps", "acc_m", "quality")


@query(f"SELECT session, seq AS t_ns, lat, lon, CASE WHEN used % 2 = 1 THEN 'LOST' ELSE 'GOOD' END AS quality FROM {FIX}")
def src_06_track(spark, sf):
    f = fix(spark, sf).select("session", F.concat_ws(",", F.col("seq").cast("string"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit(",,,,,0"), (F.col("used") % 2).cast("string")).alias("value"))
    return readers.parse_track(f)


@query(f"SELECT session, CASE WHEN used > 3 THEN lat ELSE lat + 1 END AS lat, lon FROM {FIX}")
def src_07_matches(spark, sf):
    s = lambda c: F.col(c).cast("string")
    f = fix(spark, sf).withColumn("lat1", F.col("lat") + 1)
    text = F.concat_ws(",", F.when(F.col("used") > 3, s("lat")).otherwise(""), F.when(F.col("used") > 3, s("lon")).otherwise(""), s("lat1"), s("lon"))
    return readers.parse_matches(f.select("session", text.alias("value")), ["snap_lat", "snap_lon", "lat", "lon"])


@query(f"SELECT session, seq, CASE WHEN used > 1 THEN CAST(seq AS DOUBLE) ELSE 0 END AS duration_s, CASE WHEN used > 1 THEN event_id ELSE 0 END AS imu_samples, CAST(0 AS BIGINT) AS gps_fixes FROM {FIX}")
def src_09_summary(spark, sf):
    f = fix(spark, sf)
    text = F.when(F.col("used") > 1, F.format_string('{"summary": {"duration_s": %d, "imu_samples": %d}}', "seq", "event_id")).otherwise("{broken")
    return readers.parse_summary(f.select("session", "seq", text.alias("value")))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS c0, CAST(NULL AS DOUBLE) AS c1, p_retailprice AS c2, CAST(NULL AS DOUBLE) AS c3 FROM part")
def src_10_numeric(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat_ws(",", F.col("p_size").cast("string"), F.lit("x y"), F.col("p_retailprice").cast("string")).alias("value"))
    return readers.parse_numeric(p, 4)


@query("SELECT s.p_brand AS dir, '-' || CAST(s.p_size AS VARCHAR) AS stem FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 0) s JOIN (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 1) v ON s.p_brand = v.p_brand AND s.p_size = v.p_size")
def src_11_pairs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("dir"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "S-").otherwise("V-"), F.lit("-"), F.col("p_size").cast("string")).alias("name")).distinct()
    return readers.pairs(p).select("dir", "stem")


@query(f"SELECT seg_id, round({geo.bearing('alat', 'alon', 'blat', 'blon')}, 4) AS bearing, round({geo.local_metres('alat', 'alon', 'blat', 'blon')}, 4) AS len_m FROM {SEG} WHERE seg_id % 7 > 0")
def src_12_roads(spark, sf):
    s = relation(spark, sf, "d_seg")
    same = F.col("seg_id") % 7 == 0
    text = F.concat_ws(",", *(F.col(c).cast("string") for c in ("alat", "alon")), F.when(same, F.col("alat")).otherwise(F.col("blat")).cast("string"), F.when(same, F.col("alon")).otherwise(F.col("blon")).cast("string"), "cls")
    return readers.parse_roads(s.select("seg_id", text.alias("value"))).select("seg_id", r("bearing", 4).alias("bearing"), r("len_m", 4).alias("len_m"))


@query(f"SELECT session AS id, seq AS k, lat AS alat, nlat AS blat FROM (SELECT session, seq, lat, lead(lat) OVER (PARTITION BY session ORDER BY seq) AS nlat FROM {FIX}) WHERE nlat IS NOT NULL AND session % 3 > 0")
def src_13_14_ways(spark, sf):
    f = fix(spark, sf).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("g"))
    way = F.struct(F.lit("way").alias("type"), F.col("session").alias("id"), F.create_map(F.lit("highway"), F.when(F.col("session") % 3 > 0, "primary").otherwise("footway")).alias("tags"), F.expr("transform(g, p -> named_struct('lat', p.lat, 'lon', p.lon))").alias("geometry"))
    text = F.to_json(F.struct(F.array(way, way).alias("elements")))
    return readers.parse_ways(f.select(text.alias("value"))).select("id", F.col("k").cast("long").alias("k"), "alat", "blat")


@query(f"SELECT session, CAST(count(*) AS BIGINT) AS n, min(lat) AS south FROM {FIX} GROUP BY 1")
def src_21_route(spark, sf):
    f = fix(spark, sf).groupBy("session").agg(F.collect_list(F.array("lon", "lat")).alias("c"))
    text = F.to_json(F.struct(F.array(F.struct(F.col("session").cast("double").alias("distance"), F.lit(1.5).alias("duration"), F.struct(F.col("c").alias("coordinates")).alias("geometry"))).alias("routes")))
    out = readers.parse_route(f.select(text.alias("value")))
    return out.select(F.col("distance").cast("long").alias("session"), F.size("points").cast("long").alias("n"), F.expr("array_min(transform(points, p -> p.lat))").alias("south"))


@query(f"""SELECT session, seq, min_by(name, (area, name)) AS map FROM (SELECT f.session, f.seq, m.name, (m.n - m.s) * (m.e - m.w) AS area FROM {FIX} f
 JOIN (VALUES ('all', 20.0, 25.0, 85.0, 90.0), ('near', 22.3, 22.305, 87.0, 88.0), ('tiny', 22.3, 22.302, 87.3, 87.301)) m(name, s, n, w, e) ON f.lat BETWEEN m.s AND m.n AND f.lon BETWEEN m.w AND m.e) GROUP BY 1, 2""")
def src_22_flt_20_covering(spark, sf):
    maps = spark.createDataFrame([("all", 20.0, 25.0, 85.0, 90.0), ("near", 22.3, 22.305, 87.0, 88.0), ("tiny", 22.3, 22.302, 87.3, 87.301)], "name string, south double, north double, west double, east double")
    f = fix(spark, sf).withColumn("key", F.struct("session", "seq"))
    return readers.covering(maps, f, "key").select("key.session", "key.seq", "map")


@query(f"SELECT session, seq, acc, speed, bearing FROM {FIX} WHERE speed > 2 AND session IN (SELECT session FROM {FIX} WHERE speed > 2 GROUP BY 1 HAVING count(*) >= 5)")
def src_25_moving_tracks(spark, sf):
    return readers.moving_tracks(fix(spark, sf), least=5).select("session", "seq", "acc", "speed", "bearing")


@query(f"SELECT session, 'way[\"highway\"](' || printf('%.6f', min(lat)) || ',' || printf('%.6f', min(lon)) || ')' AS q FROM {FIX} GROUP BY 1")
def src_26_area_query(spark, sf):
    f = fix(spark, sf).groupBy("session").agg(F.min("lat").alias("s"), F.min("lon").alias("w"))
    q = readers.area_query(F.col("s"), F.col("w"), F.col("s") + 1, F.col("w") + 1)
    return f.select("session", F.concat(F.lit('way["highway"]('), F.regexp_extract(q, r"\(([-0-9.]+,[-0-9.]+),[-0-9.]+,", 1), F.lit(")")).alias("q"))


@query(f"SELECT session, seq, s.sensor, printf('%.6f', CASE s.sensor WHEN 'a' THEN speed WHEN 'b' THEN acc END) AS v0 FROM {FIX}, (VALUES ('a'), ('b')) s(sensor)")
def snk_03_unpivot(spark, sf):
    return sinks.long_sensors(fix(spark, sf), ["session", "seq"], {"a": ("speed", "acc", "lat"), "b": ("acc", "lat", "lon")}).select("session", "seq", "sensor", "v0")


@query(f'SELECT session, seq AS "index", lat, lon FROM {FIX}')
def snk_04_numbered_track(spark, sf):
    return sinks.numbered_track(fix(spark, sf), "session", "seq")


@query(f"SELECT session, count(*) AS length, CAST(sum(count(*)) OVER (ORDER BY session) - count(*) AS BIGINT) AS start FROM {FIX} GROUP BY 1")
def snk_05_bundle(spark, sf):
    return sinks.bundle_offsets(fix(spark, sf), "session")


@query(f"SELECT session, seq, {run_reason('speed / 10', 'acc / 40', 'bearing', 0.5)} AS reason, {run_reason('speed / 10', 'acc / 40', 'bearing', 0.5)} IS NULL AS accepted FROM {FIX}")
def snk_07_manifest(spark, sf):
    return sinks.manifest(fix(spark, sf).select("session", "seq", "speed", "acc", "bearing"), F.expr(run_reason("speed / 10", "acc / 40", "bearing", 0.5))).drop("speed", "acc", "bearing")


@query(f"SELECT printf('%.7f', alat) AS alat, printf('%.7f', alon) AS alon, printf('%.7f', blat) AS blat, printf('%.7f', blon) AS blon, cls FROM {SEG}")
def snk_08_roads(spark, sf):
    return sinks.road_rows(relation(spark, sf, "d_seg"))


@query(f"""WITH m AS (SELECT session, t_s + CAST(0.4 AS DOUBLE) AS t_s, acc AS mu FROM {FIX} WHERE event_id % 6 > 0), f AS (SELECT session, t_s, speed FROM {FIX} WHERE event_id % 3 = 0),
k AS (SELECT session FROM m GROUP BY 1 HAVING count(*) >= 10 INTERSECT SELECT session FROM f GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT m.session, m.t_s, mu, CASE WHEN b.t_s = a.t_s THEN a.speed ELSE a.speed + (b.speed - a.speed) * (m.t_s - a.t_s) / (b.t_s - a.t_s) END AS truth FROM m ASOF JOIN f a ON a.session = m.session AND m.t_s >= a.t_s ASOF JOIN f b ON b.session = m.session AND m.t_s <= b.t_s WHERE m.session IN (SELECT session FROM k))
SELECT session, t_s, mu, round(truth, 6) AS truth FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM x) WHERE n >= 10""")
def src_08_model_pairs(spark, sf):
    f = fix(spark, sf)
    m = f.where("event_id % 6 > 0").select("session", (F.col("t_s") + 0.4).alias("t_s"), F.col("acc").alias("mu"))
    return readers.model_pairs(m, f.where("event_id % 3 = 0"), "session", "t_s").withColumn("truth", r("truth"))


@query(f"SELECT session, seq, speed AS ax, acc AS gz, bearing AS gps_bearing FROM {FIX} WHERE session IN (SELECT session FROM {FIX} GROUP BY 1 HAVING count(*) >= 60)")
def src_16_positional(spark, sf):
    c = {9: "speed", 17: "acc", 4: "bearing"}
    text = F.concat_ws(",", *(F.col(c[k]).cast("string") if k in c else F.lit("0") for k in range(24)))
    return readers.parse_positional(fix(spark, sf).select("session", "seq", text.alias("value")), "session", 4).select("session", "seq", "ax", "gz", "gps_bearing")


@query("SELECT l_suppkey AS run, i, CAST(i - s.start AS BIGINT) AS place FROM (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber) - 1 AS i FROM lineitem) l JOIN (SELECT run, sum(n) OVER (ORDER BY run) - n AS start FROM (SELECT l_suppkey AS run, count(*) AS n FROM lineitem GROUP BY 1)) s ON s.run = l_suppkey")
def src_17_bundle_slices(spark, sf):
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("run"), "l_orderkey", "l_linenumber")
    o = sinks.bundle_offsets(rows, "run")
    place = F.row_number().over(Window.partitionBy("run").orderBy("l_orderkey", "l_linenumber")) - 1
    laid = rows.withColumn("p", place).join(o.select("run", "start"), "run").select((F.col("start") + F.col("p")).alias("i"))
    return readers.run_slices(laid, o, "run", "i").select("run", "i", "place")


@query(f"SELECT session, seq AS t_ns, CAST(used AS INTEGER) AS svid, CASE WHEN event_id % 3 > 0 THEN acc END AS cn0_dbhz, CASE WHEN event_id % 4 > 0 THEN CAST(event_id AS BIGINT) END AS full_bias_ns FROM {FIX}")
def src_19_raw_gnss(spark, sf):
    f, names = fix(spark, sf), list(readers.RAW_GNSS)
    at = {"t_ns": F.col("seq").cast("string"), "svid": F.col("used").cast("string"), "cn0_dbhz": F.when(F.col("event_id") % 3 > 0, F.col("acc").cast("string")).otherwise(""), "full_bias_ns": F.when(F.col("event_id") % 4 > 0, F.col("event_id").cast("string")).otherwise("")}
    text = F.concat_ws(",", *(at.get(n, F.lit("")) for n in names))
    return readers.parse_raw_gnss(f.select("session", text.alias("value"))).select("session", "t_ns", "svid", "cn0_dbhz", "full_bias_ns")


@query("SELECT title, subtitle, round(distance, 3) AS distance FROM (SELECT n_name AS title, 'part ' || n_regionkey || ', world' AS subtitle, 12742000 * asin(sqrt(pow(sin(radians(n_nationkey) / 2), 2))) AS distance FROM nation) ORDER BY distance, title LIMIT 6")
def src_20_places(spark, sf):
    place = F.struct(F.concat("n_name", F.lit(", part "), F.col("n_regionkey").cast("string"), F.lit(", world")).alias("display_name"), F.col("n_nationkey").cast("string").alias("lat"), F.lit("0").alias("lon"))
    j = spark.read.parquet(f"{sf}/nation.parquet").agg(F.to_json(F.collect_list(place)).alias("value"))
    return readers.parse_places(j, 0.0, 0.0).select("title", "subtitle", r("distance", 3).alias("distance"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS valid FROM part")
def src_23_magic(spark, sf):
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit("mapsforge binary OSM and more")).when(F.col("p_partkey") % 3 == 1, F.lit("mapsforge binary")).otherwise(F.col("p_name"))
    return readers.has_magic(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.cast("binary").alias("content"))).select("p_partkey", "valid")


@query(f"""WITH g AS (SELECT session, t_ns + 40000000 AS t FROM {IMU} WHERE sensor = 'gyro'), a AS (SELECT session, t_ns AS t, v2 FROM {IMU} WHERE sensor = 'accel'), n AS (SELECT session FROM a GROUP BY 1 HAVING count(*) > 1)
SELECT g.session, g.t AS t_ns, round(CASE WHEN q.t = p.t THEN p.v2 ELSE coalesce(p.v2 + (q.v2 - p.v2) * CAST(g.t - p.t AS DOUBLE) / CAST(q.t - p.t AS DOUBLE), p.v2, q.v2) END, 6) AS v2 FROM g JOIN n ON n.session = g.session ASOF LEFT JOIN a p ON p.session = g.session AND g.t >= p.t ASOF LEFT JOIN a q ON q.session = g.session AND g.t <= q.t""")
def src_24_resampled(spark, sf):
    i = relation(spark, sf, "d_imu")
    grid = i.where("sensor = 'gyro'").select("session", (F.col("t_ns") + 40_000_000).alias("t_ns"))
    one = i.where("sensor = 'accel'").select("session").groupBy("session").count().where("count > 1").select("session")
    return readers.resampled(i, grid.join(one, "session"), "session", "t_ns", "accel", ["v2"]).select("session", "t_ns", r("v2").alias("v2"))


@query("SELECT c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS duration_s, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) END AS imu_samples FROM customer")
def snk_02_metadata(spark, sf):
    done = F.col("c_custkey") % 2 == 0
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("session_id"), F.lit("1.0").alias("app_version"), F.when(done, F.col("c_acctbal")).alias("duration_s"), F.col("c_nationkey").alias("imu_samples"), F.lit(0).alias("gps_fixes"))
    j = F.from_json("json", "session_id long, summary struct<duration_s: double, imu_samples: long>")
    return sinks.session_metadata(c).select("session_id", j["summary"]["duration_s"].alias("duration_s"), j["summary"]["imu_samples"].alias("imu_samples"))


@query("SELECT s_suppkey AS variant, s_acctbal AS rmse, CAST(2 AS DOUBLE) AS last_mean FROM supplier")
def snk_09_training_results(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("variant"), F.col("s_acctbal").alias("rmse"))
    j = F.from_json("json", "rmse double, norm_mean array<double>, norm_sd array<double>")
    return sinks.training_results(s, [1, 2], [3, 4]).select("variant", j["rmse"].alias("rmse"), F.get(j["norm_mean"], 1).alias("last_mean"))



def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
