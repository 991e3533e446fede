"""Geodesy and angles as SQL expressions; arguments and results are expression texts in degrees, metres and seconds."""

from __future__ import annotations

import math

#: Sphere and local scale of the positions, WGS84 ellipsoid.
RADIUS_M, METRES_PER_DEGREE = 6_371_000.0, 111_132.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def d(value: float) -> str:
    """A DOUBLE literal in any dialect."""
    return f"CAST({value!r} AS DOUBLE)"


def mod(x: str, m: float) -> str:
    """Floored remainder."""
    return f"((({x}) % {d(m)} + {d(m)}) % {d(m)})"


def clamp(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"


def _haversine_a(lat1, lon1, lat2, lon2) -> str:
    return f"(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = _haversine_a(lat1, lon1, lat2, lon2)
    return f"({d(2 * RADIUS_M)} * atan2(sqrt({a}), sqrt(greatest(1 - {a}, {d(0.0)}))))"


def haversine_arcsine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"({d(2 * RADIUS_M)} * asin(sqrt({clamp(_haversine_a(lat1, lon1, lat2, lon2), d(0.0), d(1.0))})))"


def local_metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Equirectangular distance about the middle latitude."""
    e, n = east(lat1, lon1, lat2, lon2), north(lat1, lat2)
    return f"sqrt(power({e}, 2) + power({n}, 2))"


def east(lat1: str, lon1: str, lat2: str, lon2: str, middle: bool = True) -> str:
    at = f"(({lat1}) + ({lat2})) / 2" if middle else lat1
    return f"((({lon2}) - ({lon1})) * {d(METRES_PER_DEGREE)} * cos(radians({at})))"


def north(lat1: str, lat2: str) -> str:
    return f"((({lat2}) - ({lat1})) * {d(METRES_PER_DEGREE)})"


def metres_per_degree_lat(lat: str) -> str:
    p = f"radians({lat})"
    return f"({d(111132.92)} - {d(559.82)} * cos(2 * {p}) + {d(1.175)} * cos(4 * {p}))"


def metres_per_degree_lon(lat: str) -> str:
    p = f"radians({lat})"
    return f"({d(111412.84)} * cos({p}) - {d(93.5)} * cos(3 * {p}))"


def offset_lat(lat: str, north_m: str) -> str:
    return f"(({lat}) + ({north_m}) / {d(METRES_PER_DEGREE)})"


def offset_lon(lat: str, lon: str, east_m: str) -> str:
    return f"(({lon}) + ({east_m}) / ({d(METRES_PER_DEGREE)} * cos(radians({lat}))))"


def bearing(alat: str, alon: str, blat: str, blon: str) -> str:
    return mod(f"degrees(atan2({east(alat, alon, blat, blon)}, {north(alat, blat)}))", 360.0)


def bearing_difference(a: str, b: str) -> str:
    """Signed, in [-180, 180]: the remainder is truncated, then folded, so that +180 stays."""
    r = f"((({a}) - ({b})) % {d(360.0)})"
    return f"(CASE WHEN {r} > 180 THEN {r} - 360 WHEN {r} < -180 THEN {r} + 360 ELSE {r} END)"


def wrap180(x: str) -> str:
    return f"({mod(f'({x}) + 180', 360.0)} - 180)"


def wrap360(x: str) -> str:
    return mod(x, 360.0)


def undirected_difference(a: str, b: str) -> str:
    x = f"abs({bearing_difference(a, b)})"
    return f"least({x}, 180 - {x})"


def segment_fraction(lat: str, lon: str, alat: str, alon: str, blat: str, blon: str) -> str:
    """Place of the foot of a point on a segment, in [0, 1]; null for a segment of no length."""
    m, c = d(METRES_PER_DEGREE), f"cos(radians({lat}))"
    bx, by = f"((({blon}) - ({alon})) * {m} * {c})", f"((({blat}) - ({alat})) * {m})"
    px, py = f"((({lon}) - ({alon})) * {m} * {c})", f"((({lat}) - ({alat})) * {m})"
    size = f"({bx} * {bx} + {by} * {by})"
    return f"(CASE WHEN {size} < {d(1e-9)} THEN NULL ELSE {clamp(f'({px} * {bx} + {py} * {by}) / {size}', d(0.0), d(1.0))} END)"


def along(a: str, b: str, t: str) -> str:
    return f"(({a}) + (({b}) - ({a})) * ({t}))"


def point_fraction(offset: str, length: str, direction: str) -> str:
    """Fraction from the segment's first end of a point so far along it in a direction (1 or -1)."""
    t = clamp(f"({offset}) / greatest({length}, {d(1e-9)})", d(0.0), d(1.0))
    return f"(CASE WHEN ({direction}) >= 0 THEN {t} ELSE 1 - {t} END)"


def segment_heading(bearing_deg: str, direction: str) -> str:
    return mod(f"({bearing_deg}) + CASE WHEN ({direction}) >= 0 THEN 0 ELSE 180 END", 360.0)


def tile_x(lon: str, zoom: int) -> str:
    return f"CAST(floor((({lon}) + 180) / 360 * {2**zoom}) AS BIGINT)"


def tile_y(lat: str, zoom: int) -> str:
    p = f"radians({lat})"
    return f"CAST(floor((1 - ln(tan({p}) + 1 / cos({p})) / {d(math.pi)}) / 2 * {2**zoom}) AS BIGINT)"


def box_lat(radius_km: str) -> str:
    return f"(({radius_km}) / {d(111.32)})"


def box_lon(lat: str, radius_km: str) -> str:
    return f"(({radius_km}) / ({d(111.32)} * greatest(cos(radians({lat})), {d(0.01)})))"


def ecef(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    e2 = WGS84_F * (2 - WGS84_F)
    n = f"({d(WGS84_A)} / sqrt(1 - {d(e2)} * power(sin(radians({lat})), 2)))"
    flat = f"(({n} + ({alt})) * cos(radians({lat})))"
    return f"({flat} * cos(radians({lon})))", f"({flat} * sin(radians({lon})))", f"(({n} * {d(1 - e2)} + ({alt})) * sin(radians({lat})))"


def enu_basis(lat: str, lon: str) -> dict[str, str]:
    """East, north and up as unit vectors in ECEF."""
    sp, cp, sl, cl = f"sin(radians({lat}))", f"cos(radians({lat}))", f"sin(radians({lon}))", f"cos(radians({lon}))"
    return {"ex": f"(-{sl})", "ey": cl, "ez": d(0.0), "nx": f"(-{sp} * {cl})", "ny": f"(-{sp} * {sl})", "nz": cp, "ux": f"({cp} * {cl})", "uy": f"({cp} * {sl})", "uz": sp}


def geodesic(lat1, lon1, lat2, lon2):
    """WGS84 distance of arrays of points (Vincenty's inverse, at most 60 steps; nearly antipodal points give NaN)."""
    import numpy as np

    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    p1, p2, dl = np.radians(lat1), np.radians(lat2), np.radians(np.asarray(lon2) - np.asarray(lon1))
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = dl.copy()
    with np.errstate(all="ignore"):
        for _ in range(60):
            ss = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cs = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, c1 * c2 * np.sin(lam) / np.where(ss == 0, 1, ss))
            ca = 1 - sa**2
            cm = np.where(ca == 0, 0, cs - 2 * s1 * s2 / np.where(ca == 0, 1, ca))
            c = f / 16 * ca * (4 + f * (4 - 3 * ca))
            new = dl + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0) < 1e-12
            lam = new
            if done:
                break
        k = ca * (a * a - b * b) / (b * b)
        aa = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        bb = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        ds = bb * ss * (cm + bb / 4 * (cs * (2 * cm**2 - 1) - bb / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        return np.where(ss == 0, 0.0, b * aa * (sigma - ds))
