"""Readers of session logs, road files and service answers.

Each reader has a part that works on lines or JSON texts (``parse_*``, any DataFrame with a column ``value``) and, where
files are meant, a part that reads them. Missing fields are null, short rows are padded, long ones lose what is beyond;
what can't be read as a number is null. Nothing is inferred from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.functions.scalars import DRIVABLE

#: Columns of the logs; names under which a column may stand instead.
IMU = ("t_ns", "sensor", "accuracy", "v0", "v1", "v2", "v3", "v4", "v5")
GPS = ("t_ns", "utc_ms", "provider", "lat", "lon", "alt_m", "speed_mps", "bearing_deg", "acc_m", "vert_acc_m", "speed_acc_mps", "bearing_acc_deg")
TRACK = ("t_ns", "lat", "lon", "speed_mps", "drift_m", "bias_e", "bias_n", "bias_u", "stationary", "free_run", "gyro_bias_x", "gyro_bias_y", "gyro_bias_z", "gyro_bias_valid")
MATCH = ("t_ns", "dr_lat", "dr_lon", "snap_lat", "snap_lon", "correction_m", "road_class", "confidence", "heading_applied_deg", "mode")
ALIASES = {"lat": ("lat", "latitude"), "lon": ("lon", "lng", "longitude"), "speed_mps": ("speed_mps", "speed"), "acc_m": ("acc_m", "accuracy"), "bearing_deg": ("bearing_deg", "bearing")}
MAGIC = b"mapsforge binary OSM"
#: Indices of a bundle that are ordered together, as a power of two.
STRETCH_BITS = 16


def resolve(header: list[str], name: str) -> int | None:
    """Place of a column under its name or an alias, whatever the case."""
    low = [h.strip().lower() for h in header]
    return next((low.index(a) for a in ALIASES.get(name, (name,)) if a in low), None)


def fields(df: DataFrame, header: list[str], wanted: dict[str, str], value: str = "value") -> DataFrame:
    """Named fields of comma-separated lines, cast to the wanted types; other columns stay."""
    part = F.split(F.col(value), ",", -1)

    def field(name: str, kind: str) -> Column:
        at = resolve(header, name)
        raw = F.lit(None).cast("string") if at is None else F.nullif(F.trim(F.get(part, at)), F.lit(""))
        return raw if kind == "string" else raw.try_cast(kind)

    return df.select(*(c for c in df.columns if c != value), *(field(n, k).alias(n) for n, k in wanted.items()))


def lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """``session, block, row_seq, value``: the lines of all files below the path, by the folder that holds them.

    Files are read in splits; within a session's file lines are ordered by the offset of their split, then by ``row_seq``.
    """
    text = spark.read.option("encoding", encoding or "UTF-8").text(path)
    rows = text.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("session"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row_seq"), F.rtrim("value", F.lit("\r")).alias("value"))
    return rows.where("value <> ''")


def parse_imu(df: DataFrame, sensors: list[str] | None = None, header: tuple[str, ...] = IMU) -> DataFrame:
    """Sensor events; rows without time, sensor or a first value go, as do sensors that aren't asked for."""
    out = fields(df, list(header), {"t_ns": "long", "sensor": "string", "accuracy": "int"} | {f"v{i}": "double" for i in range(6)})
    out = out.where("t_ns IS NOT NULL AND sensor IS NOT NULL AND v0 IS NOT NULL")
    return out.where(F.col("sensor").isin(sensors)) if sensors else out


def parse_fixes(df: DataFrame, header: list[str]) -> DataFrame:
    """Fixes with ``quality``: WEAK beyond 20 m of accuracy; rows without a position go."""
    out = fields(df, header, {"t_ns": "long", "lat": "double", "lon": "double", "speed_mps": "double", "bearing_deg": "double", "acc_m": "double"})
    return out.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("quality", F.when(F.col("acc_m") > 20, "WEAK").otherwise("GOOD"))


def parse_track(df: DataFrame, header: tuple[str, ...] = TRACK) -> DataFrame:
    """Integrator track; free-running rows are LOST."""
    out = fields(df, list(header), {"t_ns": "long", "lat": "double", "lon": "double", "free_run": "int"})
    return out.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("quality", F.when(F.col("free_run") == 1, "LOST").otherwise("GOOD")).drop("free_run")


def parse_matches(df: DataFrame, header: list[str]) -> DataFrame:
    """Match track; the snapped position, or the plain one in files without it."""
    out = fields(df, header, {"snap_lat": "double", "snap_lon": "double", "lat": "double", "lon": "double"})
    out = out.withColumns({"lat": F.coalesce("snap_lat", "lat"), "lon": F.coalesce("snap_lon", "lon")}).drop("snap_lat", "snap_lon")
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


def preferred(files: DataFrame, least_bytes: int = 50) -> DataFrame:
    """Of ``session, name, size`` the recomputed file where it is larger than some bytes, else the plain one."""
    better = (F.col("name").contains("_recomputed") & (F.col("size") > least_bytes)).cast("int")
    plain = F.col("name").contains("_recomputed") & (F.col("size") <= least_bytes)
    return files.where(~plain).groupBy("session").agg(F.max_by("name", F.struct(better, "name")).alias("name"))


def parse_numeric(df: DataFrame, columns: int) -> DataFrame:
    """The first columns of each line as numbers ``c0, c1, ...``."""
    return fields(df, [f"c{i}" for i in range(columns)], {f"c{i}": "double" for i in range(columns)})


def parse_summary(df: DataFrame, value: str = "value") -> DataFrame:
    """Duration and counts of a session's JSON; zero where anything is missing or broken."""
    j = F.from_json(value, "summary struct<duration_s: double, imu_samples: long, gps_fixes: long>")
    return df.select(*(c for c in df.columns if c != value), *(F.coalesce(j["summary"][n], F.lit(0)).cast(k).alias(n) for n, k in (("duration_s", "double"), ("imu_samples", "long"), ("gps_fixes", "long"))))


def sessions(found: DataFrame) -> DataFrame:
    """Of ``name, root_rank, has_files`` one row for each name: that of the first root; newest name first."""
    w = Window.partitionBy("name").orderBy("root_rank")
    return found.where("has_files").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").orderBy(F.desc("name"))


def pairs(files: DataFrame) -> DataFrame:
    """``S-x.csv`` with ``V-x.csv`` of the same folder, from ``dir, name``."""
    stem = files.withColumns({"kind": F.substring("name", 1, 2), "stem": F.expr("substring(name, 3)")})
    s, v = (stem.where(F.col("kind") == k).select("dir", "stem", F.col("name").alias(n)) for k, n in (("S-", "phone"), ("V-", "vehicle")))
    return s.join(v, ["dir", "stem"]).orderBy("dir", "stem")


def parse_roads(df: DataFrame) -> DataFrame:
    """Road segments with bearing and length; those of no length go."""
    out = fields(df, ["alat", "alon", "blat", "blon", "cls"], {"alat": "double", "alon": "double", "blat": "double", "blon": "double", "cls": "string"})
    out = out.where("alat IS NOT NULL AND blat IS NOT NULL AND alon IS NOT NULL AND blon IS NOT NULL").withColumn("len_m", F.expr(geo.local_metres("alat", "alon", "blat", "blon")))
    return out.where("len_m > 1e-6").withColumn("bearing", F.expr(geo.bearing("alat", "alon", "blat", "blon")))


WAYS = "elements array<struct<type: string, id: bigint, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>>>"


def parse_ways(df: DataFrame, value: str = "value", classes: tuple[str, ...] = DRIVABLE) -> DataFrame:
    """Segments of the ways of a JSON answer: each way once, drivable classes, no segment without length."""
    e = df.select(F.explode(F.from_json(value, WAYS)["elements"]).alias("e")).select("e.*").where("type = 'way'").dropDuplicates(["id"])
    e = e.withColumn("cls", F.col("tags")["highway"]).where(F.col("cls").isin(*classes)).where(F.size("geometry") > 1)
    s = e.select("id", "cls", F.posexplode(F.expr("zip_with(slice(geometry, 1, size(geometry) - 1), slice(geometry, 2, size(geometry) - 1), (a, b) -> named_struct('alat', a.lat, 'alon', a.lon, 'blat', b.lat, 'blon', b.lon))")).alias("k", "s"))
    return s.select("id", "k", "cls", "s.*").where("alat <> blat OR alon <> blon")


def parse_places(df: DataFrame, lat: float | None = None, lon: float | None = None, most: int = 6, value: str = "value") -> DataFrame:
    """Search results: title and subtitle around the first comma, nearest first, nulls last."""
    p = df.select(F.explode(F.from_json(value, "array<struct<display_name: string, lat: string, lon: string>>")).alias("p")).select("p.*")
    p = p.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "_p": F.split("display_name", ",", 2)})
    dist = F.lit(None).cast("double") if lat is None or lon is None else F.expr(geo.haversine(geo.d(lat), geo.d(lon), "lat", "lon"))
    out = p.select(F.trim(F.get("_p", 0)).alias("title"), F.coalesce(F.trim(F.get("_p", 1)), F.lit("")).alias("subtitle"), "lat", "lon", dist.alias("distance"))
    return out.orderBy(F.asc_nulls_last("distance"), "title").limit(most)


def parse_route(df: DataFrame, value: str = "value") -> DataFrame:
    """Points (latitude first), distance and duration of the first route of a JSON answer."""
    j = F.from_json(value, "routes array<struct<distance: double, duration: double, geometry: struct<coordinates: array<array<double>>>>>")["routes"]
    one = df.select(F.get(j, 0).alias("r")).where("r IS NOT NULL")
    return one.select(F.expr("transform(r.geometry.coordinates, c -> named_struct('lat', c[1], 'lon', c[0]))").alias("points"), F.col("r.distance").alias("distance"), F.col("r.duration").alias("duration"))


def covering(maps: DataFrame, points: DataFrame, point_key: str) -> DataFrame:
    """For each point the smallest map that contains it (ties by name); boxes and points meet by whole degrees."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int")))
    m = maps.withColumn("_y", cells("south", "north")).withColumn("_x", cells("west", "east"))
    p = points.withColumns({"_y": F.floor("lat").cast("int"), "_x": F.floor("lon").cast("int")})
    inside = p.join(m, ["_y", "_x"]).where("lat BETWEEN south AND north AND lon BETWEEN west AND east")
    return inside.groupBy(point_key).agg(F.min_by("name", F.struct((F.col("north") - F.col("south")) * (F.col("east") - F.col("west")), "name")).alias("map"))


def has_magic(files: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """``binaryFile`` rows with ``valid``: whether the content starts as it must."""
    return files.withColumn("valid", F.col("content").isNotNull() & (F.expr(f"substring(content, 1, {len(magic)})") == F.lit(magic)))


def moving_tracks(fixes: DataFrame, key: str = "session", least: int = 30) -> DataFrame:
    """Fixes with accuracy, speed over 2 m/s and bearing, of series with enough of them."""
    rows = fixes.where("acc IS NOT NULL AND speed > 2 AND bearing IS NOT NULL")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") >= least).drop("_n")


def area_query(south: Column, west: Column, north: Column, east: Column, timeout: int = 180, classes: tuple[str, ...] = DRIVABLE) -> Column:
    """Text of a road query for a box, to six decimals."""
    return F.format_string(f'[out:json][timeout:{timeout}];way["highway"~"^({"|".join(classes)})$"](%.6f,%.6f,%.6f,%.6f);out geom;', south, west, north, east)


def sensor_stream(spark: SparkSession, path: str) -> DataFrame:
    """The long sensor log as a stream of files."""
    kinds = ", ".join(f"{n} {'bigint' if n == 't_ns' else 'string' if n == 'sensor' else 'int' if n == 'accuracy' else 'double'}" for n in IMU)
    return spark.readStream.schema(kinds).option("header", True).csv(path)


#: Streams of the logger with their periods in microseconds, columns of raw satellite measurements.
STREAMS = {"accel": 5_000, "gyro": 5_000, "mag": 20_000, "accel_uncal": 5_000, "gyro_uncal": 5_000, "mag_uncal": 20_000, "rv": 20_000, "game_rv": 10_000, "gravity": 20_000, "linear_accel": 10_000, "pressure": 40_000}
RAW_GNSS = {
    "t_ns": "long", "clock_time_ns": "long", "full_bias_ns": "long", "bias_ns": "double", "drift_nsps": "double", "drift_unc_nsps": "double", "hw_clock_discontinuity": "int", "leap_second": "int", "svid": "int", "constellation": "int", "state": "int",
    "received_sv_time_ns": "long", "received_sv_time_unc_ns": "long", "cn0_dbhz": "double", "pr_rate_mps": "double", "pr_rate_unc_mps": "double", "adr_m": "double", "adr_unc_m": "double", "adr_state": "int", "carrier_freq_hz": "double", "multipath": "int",
}
#: Columns of the older model's file by place: acceleration, turn rates, field, gravity, speed, bearing.
POSITIONAL = {"ax": 9, "ay": 10, "az": 11, "gx": 15, "gy": 16, "gz": 17, "mx": 18, "my": 19, "mz": 20, "grav_x": 21, "grav_y": 22, "grav_z": 23, "gps_speed": 3, "gps_bearing": 4}


def parse_raw_gnss(df: DataFrame, header: tuple[str, ...] = tuple(RAW_GNSS)) -> DataFrame:
    """Raw satellite measurements; what a device doesn't give is an empty field, and null."""
    return fields(df, list(header), RAW_GNSS).where("t_ns IS NOT NULL")


def parse_positional(df: DataFrame, key: str, hz: int = 100, value: str = "value") -> DataFrame:
    """The older model's fourteen columns by place, of files with 15 s of rows at least; the others have none."""
    part = F.split(F.col(value), ",", -1)
    out = df.select(*(c for c in df.columns if c != value), *(F.nullif(F.trim(F.get(part, k)), F.lit("")).try_cast("double").alias(n) for n, k in POSITIONAL.items()))
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") >= 15 * hz).drop("_n")


def model_pairs(model: DataFrame, fixes: DataFrame, key: str, t: str, least_rows: int = 10, least_fixes: int = 5) -> DataFrame:
    """``key, t, mu, truth``: a model's speeds inside the span of the fixes with the fixes' speed along a line between them.

    Sessions with fewer than ten model rows, in all or inside, or five fixes go; rows without a number count as none.
    """
    from wayfold.operators import align

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    m = model.where(finite("mu")).withColumn("_all", F.count("*").over(Window.partitionBy(key))).where(F.col("_all") >= least_rows).select(key, t, "mu")
    f = fixes.where(finite("speed")).withColumn("_f", F.count("*").over(Window.partitionBy(key))).where(F.col("_f") >= least_fixes).select(key, t, F.col("speed").alias("truth"))
    a = align.interpolate(m, f, key, t, "truth", inside_only=True).where("truth IS NOT NULL")
    return a.withColumn("_in", F.count("*").over(Window.partitionBy(key))).where(F.col("_in") >= least_rows).select(key, t, "mu", "truth")


def resampled(samples: DataFrame, grid: DataFrame, key: str, t: str, sensor: str, values: list[str]) -> DataFrame:
    """One sensor's values along lines between its samples, at the times of a grid."""
    from wayfold.operators import align

    out, one = grid, samples.where(F.col("sensor") == sensor)
    for v in values:
        out = align.interpolate(out, one, key, t, v)
    return out


def run_slices(rows: DataFrame, offsets: DataFrame, run: str, index: str) -> DataFrame:
    """Rows of a bundle with their run and place in it: by ``start`` and ``length`` of the runs, which don't overlap; rows outside all runs go.

    Runs and rows are united and ordered once for each stretch of indices, and a run stands in each stretch that it reaches:
    nothing has a row for each index but the rows themselves.
    """
    start, row, found = F.col("start").cast("long"), F.col("_row"), F.col("_run")
    stretch = lambda at: F.shiftright(at, STRETCH_BITS)
    o = offsets.where("length > 0").withColumn("_s", F.explode(F.sequence(stretch(start), stretch(start + F.col("length") - 1))))
    heads = o.select("_s", start.alias("_i"), F.lit(0).alias("_k"), F.struct(F.col(run), start.alias("start"), (start + F.col("length")).alias("end")).alias("_run"))
    at = F.col(index).cast("long")
    body = rows.where(at.isNotNull()).select(stretch(at).alias("_s"), at.alias("_i"), F.lit(1).alias("_k"), F.struct(*rows.columns).alias("_row"))
    w = Window.partitionBy("_s").orderBy("_i", "_k").rowsBetween(Window.unboundedPreceding, 0)
    laid = heads.unionByName(body, allowMissingColumns=True).withColumn("_run", F.last("_run", True).over(w)).where(row.isNotNull() & (F.col("_i") < found["end"]))
    return laid.select(*(row[c].alias(c) for c in (index, *(c for c in rows.columns if c != index))), found[run].alias(run), (row[index] - found["start"]).alias("place"))
