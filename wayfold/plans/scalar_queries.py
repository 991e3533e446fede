"""Queries of the scalar functions over derived relations: one column for each expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo, rotation, scalars
from wayfold.functions.geo import d
from wayfold.plans import scalar_sql
from wayfold.plans.fixtures import relation

P = ("lat", "lon", "lat0", "lon0")  # a fix and the one before it
Q = ("x", "y", "z", "w")
R = rotation.matrix(*Q)


def rounded(x: str, places: int = 6) -> str:
    return f"(round({x}, {places}) + 0)"


def _all(prefix: str, parts: dict[str, str] | tuple[str, ...]) -> dict[str, str]:
    pairs = parts.items() if isinstance(parts, dict) else zip(("x", "y", "z"), parts)
    return {f"{prefix}{k}": rounded(v) for k, v in pairs}


#: name: (relation or SQL over relations, key columns, expressions)
_FIX2 = f"SELECT f.*, lag(lat, 1, {d(22.3)}) OVER (PARTITION BY session ORDER BY seq) AS lat0, lag(lon, 1, {d(87.3)}) OVER (PARTITION BY session ORDER BY seq) AS lon0 FROM {{d_fix}} f"
_FIX = "SELECT * FROM {d_fix} f"
_SEGS = "SELECT * FROM {d_seg} f"
_QUAT = "SELECT * FROM {d_quat} f"
SPECS: dict[str, tuple[str, tuple[str, ...], dict[str, str]]] = {
    "geo_01_haversine": (_FIX2, ("session", "seq"), {"m": rounded(geo.haversine(*P), 4)}),
    "geo_02_haversine_arcsine": (_FIX2, ("session", "seq"), {"m": rounded(geo.haversine_arcsine(*P), 4)}),
    "geo_03_local_metres": (_FIX2, ("session", "seq"), {"m": rounded(geo.local_metres(*P), 4)}),
    "geo_04_enu_offsets": (_FIX, ("session", "seq"), {"east": rounded(geo.east("CAST(22.3 AS DOUBLE)", d(87.3), "lat", "lon", False), 4), "north": rounded(geo.north(d(22.3), "lat"), 4)}),
    "geo_05_metres_per_degree": (_FIX, ("session", "seq"), {"mlat": rounded(geo.metres_per_degree_lat("lat"), 4), "mlon": rounded(geo.metres_per_degree_lon("lat"), 4)}),
    "geo_07_enu_to_position": (_FIX, ("session", "seq"), {"lat2": rounded(geo.offset_lat("lat", "speed * 10"), 8), "lon2": rounded(geo.offset_lon("lat", "lon", "speed * -7"), 8)}),
    "geo_08_segment_bearing": (_SEGS, ("seg_id",), {"bearing": rounded(geo.bearing("alat", "alon", "blat", "blon"), 4)}),
    "geo_09_point_to_segment": (
        f"SELECT seg_id, alat, alon, blat, blon, alat + {d(0.0004)} AS plat, alon + {d(0.0003)} AS plon FROM {{d_seg}} f",
        ("seg_id",),
        {"t": rounded(geo.segment_fraction("plat", "plon", "alat", "alon", "blat", "blon"), 5), "m": rounded(geo.local_metres("plat", "plon", geo.along("alat", "blat", geo.segment_fraction("plat", "plon", "alat", "alon", "blat", "blon")), geo.along("alon", "blon", geo.segment_fraction("plat", "plon", "alat", "alon", "blat", "blon"))), 3)},
    ),
    "geo_10_point_at_offset": (_SEGS, ("seg_id",), {f"{k}{n}": rounded(geo.along(f"a{k}", f"b{k}", geo.point_fraction(d(35.0), geo.local_metres("alat", "alon", "blat", "blon"), str(s))), 7) for k in ("lat", "lon") for n, s in (("_fwd", 1), ("_back", -1))}),
    "geo_11_bearing_difference": (_FIX, ("session", "seq"), {"diff": rounded(geo.bearing_difference("bearing", "acc * 17")), "edge": rounded(geo.bearing_difference("bearing", "bearing - 180"))}),
    "geo_12_wraps": (_FIX, ("session", "seq"), {"half": rounded(geo.wrap180("bearing * 3 - 500")), "full": rounded(geo.wrap360("bearing * -3"))}),
    "geo_13_undirected_difference": (_FIX, ("session", "seq"), {"diff": rounded(geo.undirected_difference("bearing", "acc * 17"))}),
    "geo_14_tiles": (_FIX, ("session", "seq"), {"tx": geo.tile_x("lon", 15), "ty": geo.tile_y("lat", 15)}),
    "geo_15_radius_box": (_FIX, ("session", "seq"), {"dlat": rounded(geo.box_lat("acc")), "dlon": rounded(geo.box_lon("lat", "acc"))}),
    "geo_16_ecef": (_FIX, ("session", "seq"), {k: rounded(v, 3) for k, v in zip("xyz", geo.ecef("lat", "lon", "acc"))}),
    "geo_17_enu_basis": (_FIX, ("session", "seq"), {k: rounded(v) for k, v in geo.enu_basis("lat", "lon").items()}),
    "geo_18_segment_heading": (_FIX, ("session", "seq"), {"fwd": rounded(geo.segment_heading("bearing", "1")), "back": rounded(geo.segment_heading("bearing", "-1"))}),
    "rot_01_matrix_missing_w": (f"SELECT vec_id, x, y, z, {rotation.missing_w('x', 'y', 'z')} AS w FROM {{d_quat}} f", ("vec_id",), _all("", R)),
    "rot_02_matrix_as_is": ("SELECT vec_id, 2 * x AS x, y, z, w FROM {d_quat} f", ("vec_id",), _all("", R)),
    "rot_03_rotate_vector": (_QUAT, ("vec_id",), _all("v", rotation.rotate(R, (d(0.3), d(-0.2), d(9.81))))),
    "rot_04_quaternion": (f"SELECT vec_id, {', '.join(f'{v} AS {k}' for k, v in R.items())} FROM {{d_quat}} f", ("vec_id",), {f"abs_{k}": rounded(f"abs({v})", 5) for k, v in rotation.quaternion({m: m for m in rotation.M}).items()}),
    "rot_05_product_and_yaw": (_QUAT, ("vec_id",), _all("p", rotation.product(Q, ("w", "x", "y", "z"))) | _all("t", rotation.world_yaw(Q, d(0.7)))),
    "rot_06_level_quaternion": (_QUAT, ("vec_id",), _all("", rotation.level_quaternion(("x", "y", "z")))),
    "rot_07_frame_from_up": (_QUAT, ("vec_id",), _all("", rotation.frame(("x", "y", "abs(z) + 1"), "30 * w"))),
    "rot_08_triad": (_QUAT, ("vec_id",), _all("", rotation.triad(("x", "y", "z"), ("w", "x", "y")))),
    "rot_09_axis_azimuth": (_QUAT, ("vec_id",), {f"azimuth{k}": rounded(rotation.axis_azimuth(R, k), 4) for k in (1, 2)}),
    "rot_10_flatter_axis": (_QUAT, ("vec_id",), {"axis": rotation.flatter_axis(R)}),
    "rot_11_vectors": (_QUAT, ("vec_id",), {"n": rounded(rotation.norm("x", "y", "z")), "dot": rounded(rotation.dot(("x", "y", "z"), ("y", "z", "w")))} | _all("c", rotation.cross(("x", "y", "z"), ("y", "z", "w"))) | _all("u", rotation.unit(("x", "y", "z")))),
    "rot_12_axis_permutation": (_QUAT, ("vec_id",), {c: rounded(x) for c, x in zip("abc", rotation.permuted(("x", "y", "z")))}),
    "rot_15_sphere_cell": (_QUAT, ("vec_id",), {"cell": rotation.sphere_cell("x", "y", "z")}),
    "scl_01_units": (_FIX, ("session", "seq"), {"kmh": rounded("speed * 36 / 10"), "ms": rounded("speed * 10 / 36"), "rad": rounded("radians(bearing)"), "si": rounded(f"speed * {d(9.80665)}"), "s": rounded(f"(seq * 100000000) / {d(1e9)}")}),
    "scl_02_activations": (_FIX, ("session", "seq"), {"softplus": rounded(scalars.softplus("speed - 7")), "sigmoid": rounded(scalars.sigmoid("speed - 7")), "sd": rounded("exp((speed - 7) / 2)")}),
    "scl_03_fusion_weight": (_FIX, ("session", "seq"), {"weight": rounded(scalars.fusion_weight("speed - 7"))}),
    "scl_04_clamp": (_FIX, ("session", "seq"), {"v": rounded(geo.clamp("speed", d(2.0), d(9.0)))}),
    "scl_05_drift_percent": (_FIX, ("session", "seq"), {"percent": rounded(scalars.drift_percent("acc", "speed * 20"))}),
    "scl_06_quality": (_FIX, ("session", "seq"), {"quality": scalars.quality("seq % 17 > 0", "speed - 1", "used", "acc")}),
    "scl_07_drift_colour": (_FIX, ("session", "seq"), {"colour": scalars.drift_colour("seq % 13 > 0", "CASE WHEN seq % 11 > 0 THEN acc * 4 END", scalars.drift_percent("speed", "acc * 6"))}),
    "scl_13_oneway": ("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'true' WHEN 2 THEN '1' ELSE 'no' END AS tag FROM {part} f", ("p_partkey",), {"oneway": scalars.one_of("tag", ("yes", "true", "1"))}),
    "scl_15_eta": (_FIX, ("session", "seq"), {"eta": rounded(scalars.eta_seconds("acc * 2000", "speed - 5"))}),
    "scl_16_progress": (_FIX, ("session", "seq"), {"percent": scalars.progress_percent("seq", "used * 30")}),
    "scl_17_correction_sign": (_FIX, ("session", "seq"), {"turn": rounded(scalars.correction_sign("bearing", "acc * 11"))}),
    "scl_18_orientation_azimuth": (_QUAT, ("vec_id",), {"azimuth": rounded(f"degrees(atan2({R['r01']}, {R['r11']}))", 4)}),
    "flt_01_accurate": (_FIX + f" WHERE {scalars.accurate('acc', 'speed')}", ("session", "seq"), {"acc": "acc"}),
    "flt_02_moving": (_FIX, ("session", "seq"), {f"over_{n}": scalars.moving("speed", x) for n, x in (("2", 2.0), ("1_5", 1.5), ("1", 1.0), ("0_5", 0.5))}),
    "flt_03_healthy": (_FIX, ("session", "seq"), {"healthy": scalars.healthy("used", "acc")}),
    "flt_06_drivable": (_SEGS + f" WHERE {scalars.one_of('cls', scalars.DRIVABLE)}", ("seg_id",), {"trunk": scalars.one_of("cls", scalars.TRUNK)}),
    "flt_09_run_reason": (_FIX, ("session", "seq"), {"reason": scalars.run_reason("speed / 10", "acc / 40", "bearing", 0.5)}),
    "flt_15_disturbed": (_FIX, ("session", "seq"), {"disturbed": scalars.disturbed("speed + 40", d(45.0))}),
    "flt_16_mount_gate": (_FIX + f" WHERE {scalars.mount_learns('speed', 'acc / 5 - 4')}", ("session", "seq"), {"speed": "speed"}),
    "flt_21_calibrated": (_FIX, ("session", "seq"), {"done": scalars.calibrated("used % 4", "speed / 20", "acc / 4")}),
    "flt_22_moved_half_radius": (_FIX2, ("session", "seq"), {"refresh": f"({geo.haversine(*P)} > acc / 2)"}),
    "st_01d_heading_correction": (_FIX, ("session", "seq"), {"turn": rounded(scalars.heading_correction("bearing", "acc * 11", d(0.35), "speed"))}),
    "st_01g_uncertainty": (_FIX, ("session", "seq"), {"sigma": rounded(scalars.uncertainty("seq * speed"))}),
    "st_16_heading_priority": (_FIX, ("session", "seq"), dict(zip(("heading", "source"), scalars.heading_source("CASE WHEN used > 5 THEN bearing END", "CASE WHEN used > 2 THEN acc END", "CASE WHEN used > 0 THEN speed END")))),
    "ml_09_losses": ("SELECT * FROM {d_pred} f", ("i",), {"nll": rounded(scalars.gaussian_nll("pred", "truth / 10 - 3", "truth"), 5), "bce": rounded(scalars.bce_with_logits("pred - truth", "CASE WHEN truth > 25 THEN 1 ELSE 0 END", d(2.5)), 5)}),
    "ml_10_fine_tune_loss": ("SELECT * FROM {d_pred} f", ("i",), {"loss": rounded(f"{scalars.gaussian_nll('pred', d(0.2), 'truth')} + 2 * {scalars.bce_with_logits('pred - truth', 'CASE WHEN truth > 25 THEN 1 ELSE 0 END', d(1.0))} + {scalars.smooth_l1('pred', 'truth')} + {d(0.5)} * {scalars.sigmoid('truth - pred')} * pred * pred", 4)}),
    "ml_21_speed_weights": ("SELECT * FROM {d_pred} f", ("i",), {"weight": scalars.speed_weight("truth / 5")}),
}


def _spark(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, keys, columns = SPECS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {r: relation(spark, sf_dir, r) for r in ("d_fix", "d_imu", "d_quat", "d_seg", "d_pred") if f"{{{r}}}" in source}
        if "{part}" in source:
            frames["part"] = spark.read.parquet(f"{sf_dir}/part.parquet")
        return spark.sql(source, **frames).select(*keys, *(F.expr(e).alias(c) for c, e in columns.items()))

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _spark(name) for name in SPECS}


def oracle_sql() -> dict[str, str]:
    return {name: scalar_sql.oracle_of(name) for name in SPECS}
