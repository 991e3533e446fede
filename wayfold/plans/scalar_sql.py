"""DuckDB SQL for the scalar queries, written out from the formulas and without the library's expressions.

Where a formula has several forms another one is used: chords for great circles, vector products for rotations, half
angles for quaternions.
"""

from __future__ import annotations

from wayfold.plans.fixtures import oracle

R = 6371000


def _r(**columns: str) -> str:
    """Rounded columns; a negative zero becomes zero."""
    return ", ".join(f"round({x}, {n}) + 0 AS {c}" for c, (x, n) in ((c, v if isinstance(v, tuple) else (v, 6)) for c, v in columns.items()))


def _six(columns: dict[str, str], places: int = 6) -> str:
    return ", ".join(f"round({x}, {places}) + 0 AS {c}" for c, x in columns.items())


def full(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def half(x: str) -> str:
    return f"({full(f'({x}) + 180')} - 180)"


def chord(a: str, b: str, c: str, e: str) -> str:
    parts = ((f"cos(radians({a})) * cos(radians({b}))", f"cos(radians({c})) * cos(radians({e}))"), (f"cos(radians({a})) * sin(radians({b}))", f"cos(radians({c})) * sin(radians({e}))"), (f"sin(radians({a}))", f"sin(radians({c}))"))
    return f"({2 * R} * asin(least(1, sqrt({' + '.join(f'pow({p} - {q}, 2)' for p, q in parts)}) / 2)))"


def flat(a: str, b: str, c: str, e: str) -> str:
    return f"(111132 * sqrt(pow({c} - {a}, 2) + pow(({e} - {b}) * cos(radians({a}) / 2 + radians({c}) / 2), 2)))"


#: Signed difference of two bearings in [-180, 180]; the remainder is truncated, so that an exact 180 keeps its sign.
def turn(a: str, b: str) -> str:
    x = f"(({a}) - ({b}) - 360 * trunc((({a}) - ({b})) / 360))"
    return f"CASE WHEN {x} > 180 THEN {x} - 360 WHEN {x} < -180 THEN {x} + 360 ELSE {x} END"


def nearer(course: str, road: str) -> str:
    return f"(CASE WHEN abs({turn(road, course)}) <= abs({turn(f'{road} + 180', course)}) THEN {turn(road, course)} ELSE {turn(f'{road} + 180', course)} END)"


def soft(x: str) -> str:
    return f"(CASE WHEN {x} > 30 THEN {x} + exp(-({x})) ELSE ln(1 + exp({x})) END)"


#: Columns of the rotation of a unit quaternion: images of the axes by products of vectors.
def image(v: tuple[str, str, str], q: tuple[str, str, str, str] = ("x", "y", "z", "w")) -> tuple[str, str, str]:
    a, b, c, w = q
    t = (f"2 * ({b} * ({v[2]}) - {c} * ({v[1]}))", f"2 * ({c} * ({v[0]}) - {a} * ({v[2]}))", f"2 * ({a} * ({v[1]}) - {b} * ({v[0]}))")
    return (
        f"(({v[0]}) + {w} * {t[0]} + {b} * {t[2]} - {c} * {t[1]})",
        f"(({v[1]}) + {w} * {t[1]} + {c} * {t[0]} - {a} * {t[2]})",
        f"(({v[2]}) + {w} * {t[2]} + {a} * {t[1]} - {b} * {t[0]})",
    )


_AXES = (("1", "0", "0"), ("0", "1", "0"), ("0", "0", "1"))
_FIX, _KEYS = "FROM {d_fix} f", "session, seq"
_PREV = "FROM (SELECT *, coalesce(lag(lat) OVER w, CAST(22.3 AS DOUBLE)) AS lat0, coalesce(lag(lon) OVER w, CAST(87.3 AS DOUBLE)) AS lon0 FROM {d_fix} f WINDOW w AS (PARTITION BY session ORDER BY seq))"
_QUAT = "FROM {d_quat} f"
_UNIT = "FROM (SELECT vec_id, x / n AS ux, y / n AS uy, z / n AS uz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM {d_quat} f))"
_E2 = "(2 / 298.257223563 - pow(1 / 298.257223563, 2))"


def _matrix_of(image_of) -> dict[str, str]:
    return {f"r{i}{j}": image_of(_AXES[j])[i] for j in range(3) for i in range(3)}


def _sent(v: str, y: str) -> str:
    return f"(CAST(0.5 AS DOUBLE) * ({v}) + pow(({y}), 2) / (2 * exp({v})))"


_SIDE = "sqrt(1 - uy * uy)"
_UPRIGHT = "FROM (SELECT vec_id, radians(30 * w) AS h, x / n AS ux, y / n AS uy, (abs(z) + 1) / n AS uz FROM (SELECT *, sqrt(x * x + y * y + (abs(z) + 1) * (abs(z) + 1)) AS n FROM {d_quat} f))"
_FORWARD = ("(-uy * ux)", "(1 - uy * uy)", "(-uy * uz)")
_RIGHT = ("uz", "0", "(-ux)")
_TRIAD = "FROM (SELECT *, x * z - y * y AS e0, y * x - w * z AS e1, w * y - x * x AS e2, sqrt(x * x + y * y + z * z) AS g, sqrt(pow(x * z - y * y, 2) + pow(y * x - w * z, 2) + pow(w * y - x * x, 2)) AS n FROM {d_quat} f)"
_MEAN = "(CAST(22.3 AS DOUBLE))"
_FOOT = "greatest(0, least(1, (qx * sx + qy * sy) / (sx * sx + sy * sy)))"

SQL = {
    "geo_01_haversine": f"SELECT {_KEYS}, {_r(m=(chord('lat', 'lon', 'lat0', 'lon0'), 4))} {_PREV}",
    "geo_02_haversine_arcsine": f"SELECT {_KEYS}, {_r(m=(chord('lat0', 'lon0', 'lat', 'lon'), 4))} {_PREV}",
    "geo_03_local_metres": f"SELECT {_KEYS}, {_r(m=(flat('lat0', 'lon0', 'lat', 'lon'), 4))} {_PREV}",
    "geo_04_enu_offsets": f"SELECT {_KEYS}, {_r(east=(f'(lon - CAST(87.3 AS DOUBLE)) * 111132 * cos(pi() * {_MEAN} / 180)', 4), north=(f'111132 * (lat - {_MEAN})', 4))} {_FIX}",
    "geo_05_metres_per_degree": f"SELECT {_KEYS}, {_r(mlat=('CAST(111132.92 AS DOUBLE) - CAST(559.82 AS DOUBLE) * (2 * pow(cos(radians(lat)), 2) - 1) + CAST(1.175 AS DOUBLE) * (8 * pow(cos(radians(lat)), 4) - 8 * pow(cos(radians(lat)), 2) + 1)', 4), mlon=('CAST(111412.84 AS DOUBLE) * cos(radians(lat)) - CAST(93.5 AS DOUBLE) * (4 * pow(cos(radians(lat)), 3) - 3 * cos(radians(lat)))', 4))} {_FIX}",
    "geo_07_enu_to_position": f"SELECT {_KEYS}, {_r(lat2=('lat + 10 * speed / 111132', 8), lon2=('lon - 7 * speed / 111132 / cos(radians(lat))', 8))} {_FIX}",
    "geo_08_segment_bearing": f"SELECT seg_id, {_r(bearing=(full('90 - degrees(atan2(blat - alat, (blon - alon) * cos(radians(alat) / 2 + radians(blat) / 2)))'), 4))} FROM {{d_seg}} f",
    "geo_09_point_to_segment": f"SELECT seg_id, round({_FOOT}, 5) + 0 AS t, round({flat('plat', 'plon', f'(alat + (blat - alat) * {_FOOT})', f'(alon + (blon - alon) * {_FOOT})')}, 3) + 0 AS m FROM (SELECT *, (blon - alon) * c AS sx, blat - alat AS sy, (plon - alon) * c AS qx, plat - alat AS qy FROM (SELECT seg_id, alat, alon, blat, blon, alat + CAST(0.0004 AS DOUBLE) AS plat, alon + CAST(0.0003 AS DOUBLE) AS plon, cos(radians(alat + CAST(0.0004 AS DOUBLE))) AS c FROM {{d_seg}} f))",
    "geo_10_point_at_offset": f"SELECT seg_id, {_r(lat_fwd=('alat + (blat - alat) * p', 7), lat_back=('blat - (blat - alat) * p', 7), lon_fwd=('alon + (blon - alon) * p', 7), lon_back=('blon - (blon - alon) * p', 7))} FROM (SELECT *, least(1, 35 / {flat('alat', 'alon', 'blat', 'blon')}) AS p FROM {{d_seg}} f)",
    "geo_11_bearing_difference": f"SELECT {_KEYS}, {_r(diff=turn('bearing', 'acc * 17'), edge=turn('bearing', 'bearing - 180'))} {_FIX}",
    "geo_12_wraps": f"SELECT {_KEYS}, {_r(half=half('bearing * 3 - 500'), full=full('bearing * -3'))} {_FIX}",
    "geo_13_undirected_difference": f"SELECT {_KEYS}, round(abs({half('2 * (bearing - acc * 17)')}) / 2, 6) + 0 AS diff {_FIX}",
    "geo_14_tiles": f"SELECT {_KEYS}, CAST(floor(32768 * (lon / 360 + CAST(0.5 AS DOUBLE))) AS BIGINT) AS tx, CAST(floor(16384 * (1 - asinh(tan(radians(lat))) / pi())) AS BIGINT) AS ty {_FIX}",
    "geo_15_radius_box": f"SELECT {_KEYS}, {_r(dlat='acc / CAST(111.32 AS DOUBLE)', dlon='acc / CAST(111.32 AS DOUBLE) / greatest(CAST(0.01 AS DOUBLE), cos(radians(lat)))')} {_FIX}",
    "geo_16_ecef": f"SELECT {_KEYS}, {_r(x=('(n + acc) * cos(radians(lat)) * cos(radians(lon))', 3), y=('(n + acc) * cos(radians(lat)) * sin(radians(lon))', 3), z=(f'(n * (1 - {_E2}) + acc) * sin(radians(lat))', 3))} FROM (SELECT *, 6378137 / sqrt(1 - {_E2} * pow(sin(radians(lat)), 2)) AS n {_FIX})",
    "geo_17_enu_basis": f"SELECT {_KEYS}, {_r(ex='cos(radians(lon + 90))', ey='sin(radians(lon + 90))', nx='cos(radians(lat + 90)) * cos(radians(lon))', ny='cos(radians(lat + 90)) * sin(radians(lon))', nz='sin(radians(lat + 90))', ux='cos(radians(lat)) * cos(radians(lon))', uy='cos(radians(lat)) * sin(radians(lon))', uz='sin(radians(lat))')}, CAST(0 AS DOUBLE) AS ez {_FIX}",
    "geo_18_segment_heading": f"SELECT {_KEYS}, round(bearing, 6) AS fwd, round(CASE WHEN bearing < 180 THEN bearing + 180 ELSE bearing - 180 END, 6) AS back {_FIX}",
    "rot_01_matrix_missing_w": f"SELECT vec_id, {_six(_matrix_of(lambda v: image(v, ('x', 'y', 'z', 'w'))))} FROM (SELECT vec_id, x, y, z, abs(w) AS w FROM {{d_quat}} f)",
    "rot_02_matrix_as_is": f"SELECT vec_id, {_six({'r00': '1 - 2 * y * y - 2 * z * z', 'r01': '2 * x * y - 2 * z * w', 'r02': '2 * x * z + 2 * y * w', 'r10': '2 * x * y + 2 * z * w', 'r11': '1 - 2 * x * x - 2 * z * z', 'r12': '2 * y * z - 2 * x * w', 'r20': '2 * x * z - 2 * y * w', 'r21': '2 * y * z + 2 * x * w', 'r22': '1 - 2 * x * x - 2 * y * y'})} FROM (SELECT vec_id, x + x AS x, y, z, w FROM {{d_quat}} f)",
    "rot_03_rotate_vector": f"SELECT vec_id, {_six(dict(zip(('vx', 'vy', 'vz'), image(('CAST(0.3 AS DOUBLE)', 'CAST(-0.2 AS DOUBLE)', 'CAST(9.81 AS DOUBLE)')))))} {_QUAT}",
    "rot_04_quaternion": f"SELECT vec_id, {_six({f'abs_{k}': f'abs({k})' for k in 'xyzw'}, 5)} {_QUAT}",
    "rot_05_product_and_yaw": f"""SELECT vec_id, {_six({'px': 'w * w + x * z + y * y - z * x', 'py': 'w * x - x * y + y * z + z * w', 'pz': 'w * y + x * x - y * w + z * z', 'pw': 'w * z - x * w - y * x - z * y',
      'tx': 'x * cos(CAST(0.35 AS DOUBLE)) - y * sin(CAST(0.35 AS DOUBLE))', 'ty': 'y * cos(CAST(0.35 AS DOUBLE)) + x * sin(CAST(0.35 AS DOUBLE))', 'tz': 'z * cos(CAST(0.35 AS DOUBLE)) + w * sin(CAST(0.35 AS DOUBLE))', 'tw': 'w * cos(CAST(0.35 AS DOUBLE)) - z * sin(CAST(0.35 AS DOUBLE))'})} {_QUAT}""",
    "rot_06_level_quaternion": f"SELECT vec_id, {_six({'x': 'CASE WHEN uz < CAST(-0.999999 AS DOUBLE) THEN 1 ELSE uy / sqrt(2 + 2 * uz) END', 'y': 'CASE WHEN uz < CAST(-0.999999 AS DOUBLE) THEN 0 ELSE -ux / sqrt(2 + 2 * uz) END', 'z': 'CAST(0 AS DOUBLE)', 'w': 'CASE WHEN uz < CAST(-0.999999 AS DOUBLE) THEN 0 ELSE sqrt((1 + uz) / 2) END'})} {_UNIT}",
    "rot_07_frame_from_up": f"SELECT vec_id, {_six({f'r0{i}': f'({_FORWARD[i]} * sin(h) + {_RIGHT[i]} * cos(h)) / {_SIDE}' for i in range(3)} | {f'r1{i}': f'({_FORWARD[i]} * cos(h) - {_RIGHT[i]} * sin(h)) / {_SIDE}' for i in range(3)} | {'r20': 'ux', 'r21': 'uy', 'r22': 'uz'})} {_UPRIGHT}",
    "rot_08_triad": f"SELECT vec_id, {_six({k: f'CASE WHEN n < CAST(0.000001 AS DOUBLE) OR g < CAST(0.000001 AS DOUBLE) THEN {int(k[1] == k[2])} ELSE {v} END' for k, v in {'r00': 'e0 / n', 'r01': 'e1 / n', 'r02': 'e2 / n', 'r10': '(y * e2 - z * e1) / n / g', 'r11': '(z * e0 - x * e2) / n / g', 'r12': '(x * e1 - y * e0) / n / g', 'r20': 'x / g', 'r21': 'y / g', 'r22': 'z / g'}.items()})} {_TRIAD}",
    "rot_09_axis_azimuth": "SELECT vec_id, " + ", ".join(f"round(CASE WHEN pow({image(_AXES[k])[0]}, 2) + pow({image(_AXES[k])[1]}, 2) >= CAST(0.000001 AS DOUBLE) THEN {full(f'90 - degrees(atan2({image(_AXES[k])[1]}, {image(_AXES[k])[0]}))')} END, 4) + 0 AS azimuth{k}" for k in (1, 2)) + f" {_QUAT}",
    "rot_10_flatter_axis": f"SELECT vec_id, CASE WHEN abs({image(_AXES[1])[2]}) <= abs({image(_AXES[2])[2]}) THEN 1 ELSE 2 END AS axis {_QUAT}",
    "rot_11_vectors": f"SELECT vec_id, {_six({'n': 'sqrt(1 - w * w)', 'dot': 'y * (x + z) + z * w', 'cx': 'y * w - z * z', 'cy': 'z * y - x * w', 'cz': 'x * z - y * y', 'ux': 'x / sqrt(x * x + y * y + z * z)', 'uy': 'y / sqrt(x * x + y * y + z * z)', 'uz': 'z / sqrt(x * x + y * y + z * z)'})} {_QUAT}",
    "rot_12_axis_permutation": f"SELECT vec_id, round(x, 6) + 0 AS a, round(z, 6) + 0 AS b, round(y, 6) + 0 AS c {_QUAT}",
    "rot_15_sphere_cell": f"SELECT vec_id, CAST(least(5, floor(3 * (uz + 1))) * 12 + least(11, floor((atan2(uy, ux) / pi() + 1) * 6)) AS BIGINT) AS cell {_UNIT}",
    "scl_01_units": f"SELECT {_KEYS}, {_r(kmh='speed * CAST(3.6 AS DOUBLE)', ms='speed / CAST(3.6 AS DOUBLE)', rad='bearing * pi() / 180', si='CAST(9.80665 AS DOUBLE) * speed', s='CAST(seq AS DOUBLE) / 10')} {_FIX}",
    "scl_02_activations": f"SELECT {_KEYS}, {_r(softplus=soft('(speed - 7)'), sigmoid='exp(speed - 7) / (1 + exp(speed - 7))', sd='sqrt(exp(speed - 7))')} {_FIX}",
    "scl_03_fusion_weight": f"SELECT {_KEYS}, {_r(weight='CASE WHEN exp(speed - 7) < CAST(0.000001 AS DOUBLE) THEN 1 / CAST(1.000001 AS DOUBLE) ELSE 1 / (1 + exp(speed - 7)) END')} {_FIX}",
    "scl_04_clamp": f"SELECT {_KEYS}, round(CASE WHEN speed < 2 THEN 2 WHEN speed > 9 THEN 9 ELSE speed END, 6) AS v {_FIX}",
    "scl_05_drift_percent": f"SELECT {_KEYS}, round(CASE WHEN speed * 20 < 50 THEN NULL ELSE acc / speed * 5 END, 6) AS percent {_FIX}",
    "scl_06_quality": f"SELECT {_KEYS}, CASE WHEN seq % 17 = 0 THEN 'IDLE' WHEN NOT (speed - 1 BETWEEN 0 AND 5) THEN 'LOST' WHEN used >= 4 AND acc >= 20 THEN 'GOOD' ELSE 'WEAK' END AS quality {_FIX}",
    "scl_07_drift_colour": f"SELECT {_KEYS}, CASE WHEN seq % 13 = 0 OR seq % 11 = 0 THEN 'idle' WHEN acc * 6 >= 50 THEN (CASE WHEN speed / (acc * 6) > CAST(0.1 AS DOUBLE) THEN 'lost' WHEN speed / (acc * 6) > CAST(0.05 AS DOUBLE) THEN 'weak' ELSE 'good' END) WHEN acc > 25 THEN 'lost' WHEN acc * 4 > 25 THEN 'weak' ELSE 'good' END AS colour {_FIX}",
    "scl_13_oneway": "SELECT p_partkey, p_size % 4 < 3 AS oneway FROM part",
    "scl_15_eta": f"SELECT {_KEYS}, round(acc * 2000 / CASE WHEN speed > 6 THEN speed - 5 WHEN acc < 5 THEN 10 WHEN acc < 25 THEN 14 ELSE 18 END, 6) AS eta {_FIX}",
    "scl_16_progress": f"SELECT {_KEYS}, CASE WHEN used = 0 THEN 0 ELSE seq * 10 // (used * 3) END AS percent {_FIX}",
    "scl_17_correction_sign": f"SELECT {_KEYS}, round({nearer('bearing', 'acc * 11')}, 6) + 0 AS turn {_FIX}",
    "scl_18_orientation_azimuth": f"SELECT vec_id, round(90 - degrees(atan2({image(_AXES[1])[1]}, {image(_AXES[1])[0]})) - CASE WHEN 90 - degrees(atan2({image(_AXES[1])[1]}, {image(_AXES[1])[0]})) > 180 THEN 360 ELSE 0 END, 4) + 0 AS azimuth {_QUAT}",
    "flt_01_accurate": f"SELECT {_KEYS}, acc {_FIX} WHERE NOT acc > 30",
    "flt_02_moving": f"SELECT {_KEYS}, speed > 2 AS over_2, speed > CAST(1.5 AS DOUBLE) AS over_1_5, speed > 1 AS over_1, speed > CAST(0.5 AS DOUBLE) AS over_0_5 {_FIX}",
    "flt_03_healthy": f"SELECT {_KEYS}, NOT (used < 4 OR acc >= 20) AS healthy {_FIX}",
    "flt_06_drivable": "SELECT seg_id, cls = 'primary' AS trunk FROM {d_seg} f WHERE cls <> 'footway'",
    "flt_09_run_reason": f"SELECT {_KEYS}, CASE WHEN speed / 10 < CAST(0.9 AS DOUBLE) THEN 'speed correlation' WHEN acc / 40 < CAST(0.5 AS DOUBLE) THEN 'yaw correlation' WHEN bearing > 60 THEN 'position offset' END AS reason {_FIX}",
    "flt_15_disturbed": f"SELECT {_KEYS}, abs(speed - 5) > 45 * CAST(0.15 AS DOUBLE) AS disturbed {_FIX}",
    "flt_16_mount_gate": f"SELECT {_KEYS}, speed {_FIX} WHERE speed >= 4 AND acc BETWEEN 5 AND 35",
    "flt_21_calibrated": f"SELECT {_KEYS}, acc >= 16 AND CASE used % 4 WHEN 3 THEN speed >= 5 WHEN 2 THEN speed >= 8 ELSE false END AS done {_FIX}",
    "flt_22_moved_half_radius": f"SELECT {_KEYS}, 2 * {chord('lat', 'lon', 'lat0', 'lon0')} > acc AS refresh {_PREV}",
    "st_01d_heading_correction": f"SELECT {_KEYS}, round(CASE WHEN speed >= 2 THEN greatest(-4, least(4, CAST(0.35 AS DOUBLE) * {nearer('bearing', 'acc * 11')})) ELSE 0 END, 6) + 0 AS turn {_FIX}",
    "st_01g_uncertainty": f"SELECT {_KEYS}, round(18 * seq * speed / 100, 6) + 0 AS sigma {_FIX}",
    "st_16_heading_priority": f"SELECT {_KEYS}, CASE WHEN used > 5 THEN bearing WHEN used > 2 THEN acc WHEN used > 0 THEN speed END AS heading, CASE WHEN used > 5 THEN 'compass' WHEN used > 2 THEN 'gyro' WHEN used > 0 THEN 'model' END AS source {_FIX}",
    "ml_09_losses": f"SELECT i, round({_sent('least(4, greatest(-6, truth / 10 - 3))', 'truth - pred')}, 5) + 0 AS nll, round(CASE WHEN truth > 25 THEN CAST(2.5 AS DOUBLE) * {soft('(truth - pred)')} ELSE {soft('(pred - truth)')} END, 5) + 0 AS bce FROM {{d_pred}} f",
    "ml_10_fine_tune_loss": f"SELECT i, round({_sent('CAST(0.2 AS DOUBLE)', 'truth - pred')} + 2 * CASE WHEN truth > 25 THEN {soft('(truth - pred)')} ELSE {soft('(pred - truth)')} END + CASE WHEN abs(pred - truth) < 1 THEN pow(pred - truth, 2) / 2 ELSE abs(pred - truth) - CAST(0.5 AS DOUBLE) END + pow(pred, 2) / (2 + 2 * exp(pred - truth)), 4) + 0 AS loss FROM {{d_pred}} f",
    "ml_21_speed_weights": "SELECT i, CASE WHEN truth <= 25 THEN 1 ELSE 2 END AS weight FROM {d_pred} f",
}


def oracle_of(name: str) -> str:
    sql = SQL[name]
    for r in ("d_fix", "d_quat", "d_seg", "d_pred"):
        sql = sql.replace(f"{{{r}}}", f"({oracle(r)})")
    return sql
