"""Units, gates, classifiers and texts as SQL expressions."""

from __future__ import annotations

from wayfold.functions.geo import bearing_difference, d

#: Road classes for driving, and those kept on long routes.
DRIVABLE = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road")
TRUNK = DRIVABLE[:10]
GRAVITY = 9.80665


def softplus(x: str) -> str:
    return f"(greatest({x}, {d(0.0)}) + ln(1 + exp(-abs({x}))))"


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def fusion_weight(logvar: str) -> str:
    return f"(1 / (1 + greatest(exp({logvar}), {d(1e-6)})))"


def drift_percent(drift_m: str, distance_m: str) -> str:
    return f"(CASE WHEN ({distance_m}) >= 50 THEN 100 * ({drift_m}) / ({distance_m}) END)"


def quality(running: str, age_s: str, used: str, cn0: str) -> str:
    """Idle when not running; lost without a fix yet (a negative age) or for more than five seconds."""
    return f"(CASE WHEN NOT ({running}) THEN 'IDLE' WHEN ({age_s}) < 0 OR ({age_s}) > 5 THEN 'LOST' WHEN ({used}) < 4 OR ({cn0}) < 20 THEN 'WEAK' ELSE 'GOOD' END)"


def drift_colour(running: str, drift_m: str, percent: str) -> str:
    """By percent of the way once that is known, by metres before."""
    by_percent = f"CASE WHEN ({percent}) > 10 THEN 'lost' WHEN ({percent}) > 5 THEN 'weak' ELSE 'good' END"
    by_metres = f"CASE WHEN ({drift_m}) > 100 THEN 'lost' WHEN ({drift_m}) > 25 THEN 'weak' ELSE 'good' END"
    return f"(CASE WHEN NOT ({running}) OR ({drift_m}) IS NULL THEN 'idle' WHEN ({percent}) IS NOT NULL THEN {by_percent} ELSE {by_metres} END)"


def calibrated(accuracy: str, coverage: str, seconds: str) -> str:
    """A gesture of four seconds: a quarter of the sphere at high accuracy (3), two fifths at medium (2)."""
    return f"(({seconds}) >= 4 AND ((({accuracy}) >= 3 AND ({coverage}) >= {d(0.25)}) OR (({accuracy}) >= 2 AND ({coverage}) >= {d(0.4)})))"


def uncertainty(metres_since_anchor: str) -> str:
    return f"({d(0.18)} * ({metres_since_anchor}))"


def heading_source(compass: str, gyro: str, model: str) -> tuple[str, str]:
    """The heading to steer by and where it comes from: compass, else gyro, else the model."""
    name = f"CASE WHEN ({compass}) IS NOT NULL THEN 'compass' WHEN ({gyro}) IS NOT NULL THEN 'gyro' WHEN ({model}) IS NOT NULL THEN 'model' END"
    return f"coalesce({compass}, {gyro}, {model})", f"({name})"


def moving(speed: str, least: float = 2.0) -> str:
    return f"(({speed}) > {d(least)})"


def accurate(accuracy: str, speed: str, most: float = 30.0) -> str:
    return f"(({accuracy}) <= {d(most)} AND ({speed}) IS NOT NULL)"


def mount_learns(speed: str, turn_dps: str) -> str:
    return f"(({speed}) >= 4 AND abs({turn_dps}) <= 3)"


def speed_weight(speed: str) -> str:
    return f"(CASE WHEN ({speed}) > 5 THEN 2 ELSE 1 END)"


def eta_seconds(distance_m: str, speed: str) -> str:
    """Time left at the live speed if moving, else at one by distance."""
    by = f"CASE WHEN ({distance_m}) < 10000 THEN 10 WHEN ({distance_m}) < 50000 THEN 14 ELSE 18 END"
    return f"(({distance_m}) / CASE WHEN ({speed}) > 1 THEN ({speed}) ELSE {by} END)"


def progress_percent(done: str, total: str) -> str:
    return f"(CASE WHEN ({total}) > 0 THEN CAST(floor(100 * CAST({done} AS DOUBLE) / ({total})) AS BIGINT) ELSE 0 END)"


def correction_sign(course: str, road: str) -> str:
    """Signed turn toward the nearer of the road's two directions."""
    a, b = bearing_difference(road, course), bearing_difference(f"({road}) + 180", course)
    return f"(CASE WHEN abs({a}) <= abs({b}) THEN {a} ELSE {b} END)"


def heading_correction(course: str, road: str, gain: str, speed: str) -> str:
    """At most four degrees, none below two metres a second."""
    return f"(CASE WHEN ({speed}) < 2 THEN {d(0.0)} ELSE least(greatest(({gain}) * {correction_sign(course, road)}, {d(-4.0)}), {d(4.0)}) END)"


def standing(ax: str, ay: str, az: str, gyro_norm: str) -> str:
    return f"(abs(sqrt(({ax}) * ({ax}) + ({ay}) * ({ay}) + ({az}) * ({az})) - {d(GRAVITY)}) < {d(0.15)} AND ({gyro_norm}) < {d(0.05)})"


def healthy(used: str, accuracy: str) -> str:
    return f"(({used}) >= 4 AND (({accuracy}) IS NULL OR ({accuracy}) < 20))"


def disturbed(field: str, reference: str, share: float = 0.15) -> str:
    return f"(abs(({field}) / nullif({reference}, 0) - 1) > {d(share)})"


def run_reason(speed_r: str, yaw_r: str, offset_m: str, yaw_limit: float) -> str:
    """Why a run is not accepted; null if it is."""
    return f"(CASE WHEN ({speed_r}) IS NULL OR ({speed_r}) < {d(0.9)} THEN 'speed correlation' WHEN ({yaw_r}) IS NULL OR abs({yaw_r}) < {d(yaw_limit)} THEN 'yaw correlation' WHEN ({offset_m}) IS NULL OR ({offset_m}) > 60 THEN 'position offset' END)"


def one_of(x: str, values: tuple[str, ...]) -> str:
    return f"({x} IN ({', '.join(repr(v) for v in values)}))"


def gaussian_nll(mu: str, logvar: str, y: str) -> str:
    v = f"least(greatest({logvar}, {d(-6.0)}), {d(4.0)})"
    return f"({d(0.5)} * ({v} + power(({y}) - ({mu}), 2) / exp({v})))"


def bce_with_logits(logit: str, y: str, weight: str) -> str:
    return f"(({weight}) * ({y}) * {softplus(f'-({logit})')} + (1 - ({y})) * {softplus(logit)})"


def smooth_l1(a: str, b: str) -> str:
    x = f"abs(({a}) - ({b}))"
    return f"(CASE WHEN {x} < 1 THEN {d(0.5)} * {x} * {x} ELSE {x} - {d(0.5)} END)"
