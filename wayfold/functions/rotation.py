"""Rotations and vectors as SQL expressions; matrices are row-major ``r00`` to ``r22`` and turn device into east, north, up."""

from __future__ import annotations

from wayfold.functions.geo import d

M = [f"r{i}{j}" for i in range(3) for j in range(3)]


def norm(*v: str) -> str:
    return "sqrt(" + " + ".join(f"({x}) * ({x})" for x in v) + ")"


def dot(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b)) + ")"


def cross(a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple(f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))  # type: ignore[return-value]


def unit(v: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"(({x}) / nullif({norm(*v)}, 0))" for x in v)


def permuted(v: tuple[str, str, str], order: tuple[int, int, int] = (0, 2, 1)) -> tuple[str, str, str]:
    """Axes of one file order in the other; the permutation is its own inverse."""
    return tuple(v[k] for k in order)  # type: ignore[return-value]


def missing_w(x: str, y: str, z: str) -> str:
    return f"sqrt(greatest({d(0.0)}, 1 - ({x}) * ({x}) - ({y}) * ({y}) - ({z}) * ({z})))"


def matrix(x: str, y: str, z: str, w: str) -> dict[str, str]:
    """Of a quaternion as it is; give normalised parts for a rotation."""
    return {
        "r00": f"(1 - 2 * ({y} * {y} + {z} * {z}))", "r01": f"(2 * ({x} * {y} - {z} * {w}))", "r02": f"(2 * ({x} * {z} + {y} * {w}))",
        "r10": f"(2 * ({x} * {y} + {z} * {w}))", "r11": f"(1 - 2 * ({x} * {x} + {z} * {z}))", "r12": f"(2 * ({y} * {z} - {x} * {w}))",
        "r20": f"(2 * ({x} * {z} - {y} * {w}))", "r21": f"(2 * ({y} * {z} + {x} * {w}))", "r22": f"(1 - 2 * ({x} * {x} + {y} * {y}))",
    }


def rotate(r: dict[str, str], v: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple(dot((r[f"r{i}0"], r[f"r{i}1"], r[f"r{i}2"]), v) for i in range(3))  # type: ignore[return-value]


def quaternion(r: dict[str, str]) -> dict[str, str]:
    """Of a rotation matrix, by the largest of its four candidates."""
    t = f"({r['r00']} + {r['r11']} + {r['r22']})"
    cases = [
        (f"{t} > 0", f"sqrt({t} + 1) * 2", {"w": None, "x": ("r21", "-", "r12"), "y": ("r02", "-", "r20"), "z": ("r10", "-", "r01")}),
        (f"{r['r00']} > {r['r11']} AND {r['r00']} > {r['r22']}", f"sqrt(greatest({d(1e-12)}, 1 + {r['r00']} - {r['r11']} - {r['r22']})) * 2", {"x": None, "w": ("r21", "-", "r12"), "y": ("r01", "+", "r10"), "z": ("r02", "+", "r20")}),
        (f"{r['r11']} > {r['r22']}", f"sqrt(greatest({d(1e-12)}, 1 + {r['r11']} - {r['r00']} - {r['r22']})) * 2", {"y": None, "w": ("r02", "-", "r20"), "x": ("r01", "+", "r10"), "z": ("r12", "+", "r21")}),
        ("TRUE", f"sqrt(greatest({d(1e-12)}, 1 + {r['r22']} - {r['r00']} - {r['r11']})) * 2", {"z": None, "w": ("r10", "-", "r01"), "x": ("r02", "+", "r20"), "y": ("r12", "+", "r21")}),
    ]
    part = lambda s, f: f"({s}) / 4" if f is None else f"({r[f[0]]} {f[1]} {r[f[2]]}) / ({s})"
    return {k: "(CASE " + " ".join(f"WHEN {c} THEN {part(s, f[k])}" for c, s, f in cases) + " END)" for k in "xyzw"}


def product(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> dict[str, str]:
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return {
        "x": f"({aw} * {bx} + {ax} * {bw} + {ay} * {bz} - {az} * {by})", "y": f"({aw} * {by} - {ax} * {bz} + {ay} * {bw} + {az} * {bx})",
        "z": f"({aw} * {bz} + {ax} * {by} - {ay} * {bx} + {az} * {bw})", "w": f"({aw} * {bw} - {ax} * {bx} - {ay} * {by} - {az} * {bz})",
    }


def world_yaw(q: tuple[str, str, str, str], angle_rad: str) -> dict[str, str]:
    """The quaternion turned about the world's vertical."""
    return product(("0", "0", f"sin(({angle_rad}) / 2)", f"cos(({angle_rad}) / 2)"), q)


def level_quaternion(a: tuple[str, str, str]) -> dict[str, str]:
    """The shortest turn that brings measured gravity upright."""
    x, y, z = unit(a)
    raw = {"x": y, "y": f"(-{x})", "z": "0", "w": f"(1 + {z})"}
    n = norm(*raw.values())
    return {k: f"(CASE WHEN {z} < {d(-0.999999)} THEN {'1' if k == 'x' else '0'} ELSE ({v}) / nullif({n}, 0) END)" for k, v in raw.items()}


def triad(gravity: tuple[str, str, str], magnetic: tuple[str, str, str]) -> dict[str, str]:
    """East, north and up rows from gravity and magnetic field; the identity where these are parallel or none."""
    east = cross(magnetic, gravity)
    size, g = norm(*east), norm(*gravity)
    up = tuple(f"(({x}) / nullif({g}, 0))" for x in gravity)
    e = tuple(f"(({x}) / nullif({size}, 0))" for x in east)
    n = cross(up, e)
    bad = f"({size} < {d(1e-6)} OR {g} < {d(1e-6)})"
    rows = (*e, *n, *up)
    return {m: f"(CASE WHEN {bad} THEN {1 if m[1] == m[2] else 0} ELSE {x} END)" for m, x in zip(M, rows)}


def frame(up: tuple[str, str, str], heading_deg: str) -> dict[str, str]:
    """World axes in the device from the up vector and the heading of its y axis."""
    u = unit(up)
    fwd = tuple(f"({a} - {u[1]} * {b})" for a, b in zip(("0", "1", "0"), u))
    f = unit(fwd)
    r = cross(f, u)  # to the right of forward
    s, c = f"sin(radians({heading_deg}))", f"cos(radians({heading_deg}))"
    east = tuple(f"({a} * {s} + {b} * {c})" for a, b in zip(f, r))
    north = tuple(f"({a} * {c} - {b} * {s})" for a, b in zip(f, r))
    return dict(zip(M, (*east, *north, *u)))


def axis_azimuth(r: dict[str, str], axis: int) -> str:
    """Compass bearing of a body axis; null where it stands upright."""
    e, n = r[f"r0{axis}"], r[f"r1{axis}"]
    a = f"degrees(atan2({e}, {n}))"
    return f"(CASE WHEN {e} * {e} + {n} * {n} < {d(1e-6)} THEN NULL WHEN {a} < 0 THEN {a} + 360 ELSE {a} END)"


def flatter_axis(r: dict[str, str]) -> str:
    """Of the body's y and z axes the one that lies flatter: 1 or 2."""
    return f"(CASE WHEN abs({r['r21']}) <= abs({r['r22']}) THEN 1 ELSE 2 END)"


def sphere_cell(x: str, y: str, z: str, bands: int = 6, sectors: int = 12) -> str:
    """One of 72 cells of equal area of the sphere."""
    u = unit((x, y, z))
    band = f"least({bands - 1}, greatest(0, CAST(floor(({u[2]} + 1) / 2 * {bands}) AS BIGINT)))"
    sector = f"least({sectors - 1}, greatest(0, CAST(floor((degrees(atan2({u[1]}, {u[0]})) + 180) / 360 * {sectors}) AS BIGINT)))"
    return f"({band} * {sectors} + {sector})"
