"""Stateful operators: one step function for each, driven per session in batch or from a stream.

A step takes the state (a dict, empty at first) and one event (a dict with ``kind``) and returns an output row or None.
Batch and streaming drivers sort the events of a session they are given by time and sequence and share the steps.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[dict, dict], dict | None]

#: Fixed values of the integrator, the compass filter and the matcher, by preset where they differ.
STRAPDOWN = {
    "live": dict(max_dt=0.05, still_accel=0.15, still_gyro=0.05, hold=0.5, k_bias=0.02, k_gravity=0.02, k_gyro=0.005, k_gain=0.02, drift_share=0.18, fixed=True),
    "eval": dict(max_dt=0.05, still_accel=0.15, still_gyro=0.05, hold=0.5, k_bias=0.02, k_gravity=0.02, k_gyro=0.005, k_gain=0.0, drift_share=0.18, fixed=False),
}
COMPASS = dict(min_speed=4.0, max_turn=3.0, memory=0.98, samples=15, disturbed=0.15, hysteresis=0.2)
TAU = {"live": 3.0, "eval": 8.0}
MATCHER = {
    "live": dict(base=60.0, most=100.0, forced=150.0, gate=25.0, emission=30.0, heading=35.0, transition=25.0, same=1.0, hop=25.0, far=-12.0, turn=True, beam=12, candidates=24, budget=60.0, forced_budget=150.0, least_budget=12.0, rival=30.0, slack=30.0),
    "eval": dict(base=60.0, most=400.0, forced=400.0, gate=25.0, emission=30.0, heading=35.0, transition=25.0, same=0.5, hop=math.inf, far=-12.0, turn=False, beam=12, candidates=24, budget=math.inf, forced_budget=math.inf, least_budget=math.inf, rival=30.0, slack=30.0),
}


def wrap180(x: float) -> float:
    return (x + 180) % 360 - 180


def scales(lat: float) -> tuple[float, float]:
    """Metres of a degree of latitude and of longitude, by series."""
    p = math.radians(lat)
    return 111132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p), 111412.84 * math.cos(p) - 93.5 * math.cos(3 * p)


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> tuple[float, float]:
    """North and east from the first point to the second."""
    return (lat2 - lat1) * 111_132.0, (lon2 - lon1) * 111_132.0 * math.cos(math.radians((lat1 + lat2) / 2))


# -- integrator ------------------------------------------------------------------------------------------------------


def _point(s: dict) -> None:
    """Velocity follows the heading while the device is mounted and moves."""
    if s["fixed"] and s["speed"] > 0:
        s["v"] = [s["speed"] * math.sin(s["heading"]), s["speed"] * math.cos(s["heading"]), 0.0]


def strapdown(preset: str = "live", **changes: Any) -> Step:
    """Events: ``rotation`` (r: nine numbers), ``gyro`` and ``accel`` (x, y, z), ``yaw`` (rate, dt), ``heading`` (deg),
    ``anchor`` (lat, lon, speed, bearing, acc), ``model`` (speed, weight), ``still`` (flag), ``road`` (bearing, gain).

    An acceleration that comes late moves the clock back but isn't integrated. Outputs follow accelerations and anchors.
    """
    c = STRAPDOWN[preset] | changes
    fresh = dict(p=[0.0] * 3, v=[0.0] * 3, bias=[0.0] * 3, gyro_bias=[0.0] * 3, gravity=9.80665, heading=0.0, speed=0.0, yaw=0.0, gain=1.0, hold=0.0, clock=None, gyro_norm=0.0, r=None, origin=None, anchor=[0.0, 0.0], still=False, told_still=False, distance=0.0, drift=0.0, fixed=c["fixed"])

    def accel(s: dict, e: dict) -> bool:
        before, s["clock"] = s["clock"], e["t_ns"]
        if before is None or s["r"] is None or s["origin"] is None:
            return False
        dt = (e["t_ns"] - before) / 1e9
        if not 0 < dt <= c["max_dt"]:
            return False
        a = np.array([e["x"], e["y"], e["z"]], float)
        size = float(np.sqrt(a @ a))
        calm = abs(size - s["gravity"]) < c["still_accel"] and s["gyro_norm"] < c["still_gyro"]
        s["hold"] = s["hold"] + dt if calm or s["told_still"] else 0.0
        s["still"] = s["hold"] > c["hold"] or s["told_still"]
        turning = s["yaw"] if s["fixed"] and s["speed"] > 0.5 else 0.0
        linear = np.array(s["r"], float).reshape(3, 3) @ a - np.array([turning * s["v"][1], -turning * s["v"][0], s["gravity"]]) - s["bias"]
        if s["still"]:
            s["gravity"] += c["k_gravity"] * (size - s["gravity"])
            s["bias"] = [b + c["k_bias"] * x for b, x in zip(s["bias"], linear.tolist())]
            s["v"], s["speed"] = [0.0] * 3, 0.0
        elif s["fixed"]:
            ahead = linear[0] * math.sin(s["heading"]) + linear[1] * math.cos(s["heading"])
            s["speed"] = max(0.0, s["speed"] + float(ahead) * dt * s["gain"])
            s["v"] = [s["speed"] * math.sin(s["heading"]), s["speed"] * math.cos(s["heading"]), 0.0]
        else:
            s["v"] = [v + x * dt for v, x in zip(s["v"], linear.tolist())]
            s["speed"] = math.hypot(s["v"][0], s["v"][1])
        s["p"] = [p + v * dt for p, v in zip(s["p"], s["v"])]
        s["distance"] += math.hypot(s["v"][0], s["v"][1]) * dt
        s["drift"] = math.hypot(s["p"][0] - s["anchor"][0], s["p"][1] - s["anchor"][1])
        return True

    def anchor(s: dict, e: dict) -> None:
        s["origin"] = s["origin"] or [e["lat"], e["lon"]]
        by_lat, by_lon = scales(s["origin"][0])
        n, east = (e["lat"] - s["origin"][0]) * by_lat, (e["lon"] - s["origin"][1]) * by_lon
        s["p"] = [east, n, s["p"][2]]
        s["anchor"], s["drift"], s["distance"] = [east, n], 0.0, 0.0
        speed, bearing, acc = e.get("speed"), e.get("bearing"), e.get("acc")
        if speed is not None and bearing is not None:
            if speed > 3.5 and s["speed"] > 1.5 and (acc is None or acc < 4.5):
                s["gain"] += c["k_gain"] * (min(1.35, max(0.75, speed / s["speed"])) - s["gain"])
            s["speed"], s["heading"] = speed, math.radians(bearing)
            s["v"] = [speed * math.sin(s["heading"]), speed * math.cos(s["heading"]), 0.0]
        s["v"] = [s["v"][0], s["v"][1], 0.0]

    def model(s: dict, e: dict) -> None:
        target, w = max(0.0, e["speed"]), min(1.0, max(0.0, e["weight"]))
        if w <= 0 and target == 0:
            return
        if target >= 0.3 and not s["told_still"]:
            s["still"], s["hold"] = False, 0.0
        now = math.hypot(s["v"][0], s["v"][1])
        new = target if now < 0.3 else now + w * (target - now)
        if not s["fixed"] and now > 0.01:
            s["v"] = [s["v"][0] * new / now, s["v"][1] * new / now, s["v"][2]]
        else:
            s["v"] = [new * math.sin(s["heading"]), new * math.cos(s["heading"]), s["v"][2]]
        s["speed"] = new

    def step(s: dict, e: dict) -> dict | None:
        if not s:
            s |= json.loads(json.dumps(fresh))
        kind, told = e["kind"], False
        if kind == "accel":
            told = accel(s, e)
        elif kind == "gyro":
            s["gyro_norm"] = math.sqrt(e["x"] ** 2 + e["y"] ** 2 + e["z"] ** 2)
            if s["still"] or s["told_still"]:
                s["gyro_bias"] = [b + c["k_gyro"] * (e[k] - b) for b, k in zip(s["gyro_bias"], "xyz")]
        elif kind == "rotation":
            s["r"] = list(e["r"])
            if s["origin"] is None and s["speed"] < 0.3:
                s["heading"] = math.atan2(s["r"][1], s["r"][4]) % (2 * math.pi)
        elif kind == "yaw" and 0 < e["dt"] <= 1:
            s["yaw"] = e["rate"]
            s["heading"] = (s["heading"] + e["rate"] * e["dt"]) % (2 * math.pi)
            _point(s)
        elif kind == "heading" and not math.isnan(e["deg"]):
            s["heading"] = math.radians(e["deg"]) % (2 * math.pi)
            _point(s)
        elif kind == "anchor":
            anchor(s, e)
            told = True
        elif kind == "model":
            model(s, e)
        elif kind == "still":
            s["told_still"] = bool(e["flag"])
            if s["told_still"]:
                s["still"], s["v"], s["speed"] = True, [0.0] * 3, 0.0
        elif kind == "road" and math.hypot(s["v"][0], s["v"][1]) >= 2:
            course = math.degrees(s["heading"] if s["fixed"] else math.atan2(s["v"][0], s["v"][1]))
            turn = min((wrap180(e["bearing"] - course), wrap180(e["bearing"] + 180 - course)), key=abs)
            turn = math.radians(min(4.0, max(-4.0, e["gain"] * turn)))
            s["heading"] = (math.radians(course) + turn) % (2 * math.pi)
            v = math.hypot(s["v"][0], s["v"][1])
            s["v"] = [v * math.sin(s["heading"]), v * math.cos(s["heading"]), s["v"][2]]
        if not told:
            return None
        by_lat, by_lon = scales(s["origin"][0])
        lat, lon = s["origin"][0] + s["p"][1] / by_lat, s["origin"][1] + s["p"][0] / by_lon
        return dict(t_ns=e["t_ns"], lat=lat, lon=lon, speed=math.hypot(s["v"][0], s["v"][1]), heading=math.degrees(s["heading"]), still=s["still"], drift=s["drift"], sigma=c["drift_share"] * s["distance"])

    return step


# -- compass ---------------------------------------------------------------------------------------------------------


def compass(preset: str = "live") -> Step:
    """Events: ``magnetometer`` (x, y, z), ``rotation`` (r, gravity x, y, z), ``fix`` (bearing, speed, turn), ``yaw`` (clockwise rate, dt).

    Learns the angle between device and vehicle while driving straight and blends the compass with the turn rate.
    """
    c, tau = COMPASS, TAU[preset]

    def step(s: dict, e: dict) -> dict | None:
        if not s:
            s |= dict(axis="y", azimuth=None, sin=0.0, cos=0.0, n=0, offset=0.0, field=None, fields=[0.0, 0], heading=None)
        kind = e["kind"]
        reference = s["fields"][0] / s["fields"][1] if s["fields"][1] else None
        if kind == "magnetometer":
            s["field"] = math.sqrt(e["x"] ** 2 + e["y"] ** 2 + e["z"] ** 2)
        elif kind == "rotation":
            size = math.sqrt(e["x"] ** 2 + e["y"] ** 2 + e["z"] ** 2)
            if size > 1e-3:
                up = {"y": abs(e["y"]) / size, "z": abs(e["z"]) / size}
                other = "z" if s["axis"] == "y" else "y"
                if up[s["axis"]] > up[other] + c["hysteresis"]:
                    s |= dict(axis=other, sin=0.0, cos=0.0, n=0)
            east, north = (e["r"][1], e["r"][4]) if s["axis"] == "y" else (-e["r"][2], -e["r"][5])
            if east * east + north * north >= 1e-6:
                s["azimuth"] = math.degrees(math.atan2(east, north)) % 360
        elif kind == "fix":
            if e["speed"] >= c["min_speed"]:
                s["heading"] = e["bearing"] % 360
            if s["azimuth"] is not None and e["speed"] >= c["min_speed"] and abs(e["turn"]) <= c["max_turn"]:
                d = math.radians(wrap180(e["bearing"] - s["azimuth"]))
                s["sin"], s["cos"], s["n"] = s["sin"] * c["memory"] + math.sin(d), s["cos"] * c["memory"] + math.cos(d), s["n"] + 1
                s["offset"] = math.degrees(math.atan2(s["sin"], s["cos"]))
                if s["field"] is not None:
                    s["fields"] = [s["fields"][0] + s["field"], s["fields"][1] + 1]
        elif kind == "yaw":
            known = None if s["azimuth"] is None or s["n"] < c["samples"] else (s["azimuth"] + s["offset"]) % 360
            if s["heading"] is None:
                s["heading"] = known
            if s["heading"] is not None:
                h = s["heading"] + math.degrees(e["rate"]) * e["dt"]
                bad = reference is not None and s["field"] is not None and abs(s["field"] / reference - 1) > c["disturbed"]
                if known is not None and not bad:
                    h += e["dt"] / (tau + e["dt"]) * wrap180(known - h)
                s["heading"] = h % 360
            return dict(t_ns=e["t_ns"], heading=s["heading"], offset=s["offset"], samples=s["n"])
        return None

    return step


# -- matcher ---------------------------------------------------------------------------------------------------------


def matcher(preset: str = "live", graph: Any = None, **changes: Any) -> Step:
    """Events: ``fix`` (lat, lon, course, speed, sigma, force, near), ``near`` being the candidate segments by distance:
    (seg, lat, lon, dist, bearing, oneway, cls). Incremental Viterbi over a beam of snapped points.

    A call below the gate keeps the beam and, in the live preset, moves the last position on. With a road graph (and ``off``,
    the offset, in ``near``) steps are compared with distances along the roads, within a slack; what can't be reached costs.
    """
    c = MATCHER[preset] | changes

    def undirected(a: float, b: float) -> float:
        x = abs(wrap180(a - b))
        return min(x, 180 - x)

    def step(s: dict, e: dict) -> dict | None:
        if not s:
            s |= dict(beam=[], last=None)
        here = [e["lat"], e["lon"]]
        force = bool(e.get("force"))
        if not force and e["sigma"] < c["gate"]:
            s["last"] = here if preset == "live" else s["last"]
            return None
        radius = min(c["base"] + e["sigma"], c["forced"] if force else c["most"])
        near = sorted((n for n in e["near"] if n["dist"] <= radius), key=lambda n: n["dist"])[: c["candidates"]]
        last, s["last"] = s["last"], here
        if not near:
            s["beam"] = []
            return None
        moved = math.hypot(*metres(*last, *here)) if last else 0.0
        scored = []
        for n in near:
            score = -0.5 * (n["dist"] / c["emission"]) ** 2
            if e.get("course") is not None and e["speed"] >= 1.5:
                off = abs(wrap180(e["course"] - n["bearing"])) if n.get("oneway") and preset == "live" else undirected(e["course"], n["bearing"])
                score -= 0.5 * (off / c["heading"]) ** 2
            ways = []
            for h in s["beam"]:
                hop = math.hypot(*metres(h["lat"], h["lon"], n["lat"], n["lon"]))
                if graph is not None:
                    way = graph.between((h["seg"], h["off"]), (n["seg"], n["off"]), moved + c["slack"] + 2 * c["transition"])
                    t = c["far"] if math.isinf(way) else -0.5 * ((way - moved) / c["transition"]) ** 2
                    ways.append(h["score"] + t + (c["same"] if h["seg"] == n["seg"] else 0.0))
                    continue
                t = -0.5 * ((hop - moved) / c["transition"]) ** 2
                if h["seg"] == n["seg"]:
                    t += c["same"]
                else:
                    t += c["far"] if hop > c["hop"] else 0.0
                    turn = undirected(h["bearing"], n["bearing"])
                    if c["turn"] and e["speed"] > 6 and turn > 50:
                        t -= (turn - 50) / 25 * e["speed"] / 6
                ways.append(h["score"] + t)
            scored.append(n | {"score": score + max(ways, default=0.0)})
        top = max(n["score"] for n in scored)
        s["beam"] = [n | {"score": n["score"] - top} for n in sorted(scored, key=lambda n: -n["score"])[: c["beam"]]]
        head = s["beam"][0]
        rival = next((n for n in s["beam"] if undirected(n["bearing"], head["bearing"]) > c["rival"]), None)
        confidence = 1.0 if rival is None else 1 / (1 + math.exp(rival["score"] - head["score"]))
        correction = math.hypot(*metres(*here, head["lat"], head["lon"]))
        if correction > min(max(e["sigma"], c["least_budget"]), c["forced_budget"] if force else c["budget"]):
            return None
        return dict(t_ns=e["t_ns"], lat=head["lat"], lon=head["lon"], seg=head["seg"], correction=correction, confidence=confidence, bearing=head["bearing"])

    return step


# -- attitude --------------------------------------------------------------------------------------------------------


def attitude(kp: float = 1.0, ki: float = 0.02, max_dt: float = 0.5) -> Step:
    """Events: ``sample`` (gyro, accel, mag or None, dt): proportional-integral filter of a quaternion (w, x, y, z)."""

    def matrix(q: np.ndarray) -> np.ndarray:
        w, v = q[0], q[1:]
        skew = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        return np.eye(3) + 2 * w * skew + 2 * skew @ skew

    def step(s: dict, e: dict) -> dict | None:
        if not s:
            s |= dict(q=[1.0, 0.0, 0.0, 0.0], bias=[0.0] * 3, n=0)
        dt = min(max(e["dt"], 1e-3), max_dt)
        g, a = np.array(e["gyro"], float), np.array(e["accel"], float)
        if not np.isfinite(g).all():
            return None
        q, error = np.array(s["q"]), np.zeros(3)
        r = matrix(q)
        if np.isfinite(a).all() and (size := np.linalg.norm(a)) > 1e-6:
            error += np.cross(a / size, r[2])
        if e.get("mag") is not None and (size := np.linalg.norm(m := np.array(e["mag"], float))) > 1e-6:
            h = r @ (m / size)
            error += np.cross(m / size, r.T @ np.array([0.0, math.hypot(h[0], h[1]), h[2]]))
        bias = np.array(s["bias"]) + ki * error * dt
        w = g + kp * error + bias
        turn = np.concatenate(([-q[1:] @ w], q[0] * w + np.cross(q[1:], w)))
        q = q + 0.5 * turn * dt
        s |= dict(q=(q / np.linalg.norm(q)).tolist(), bias=bias.tolist(), n=s["n"] + 1)
        r = matrix(np.array(s["q"]))
        return dict(t_ns=e["t_ns"], heading=math.degrees(math.atan2(r[0, 1], r[1, 1])) % 360, up_x=r[2, 0], up_y=r[2, 1], up_z=r[2, 2], converged=s["n"] >= 200)

    return step


def smoothed_circle(gain: float = 0.35) -> Step:
    """Events with ``deg``: exponential smoothing on the circle."""

    def step(s: dict, e: dict) -> dict | None:
        s["h"] = e["deg"] % 360 if "h" not in s else (s["h"] + gain * wrap180(e["deg"] - s["h"])) % 360
        return dict(t_ns=e["t_ns"], deg=s["h"])

    return step


# -- drivers ---------------------------------------------------------------------------------------------------------


def _events(pdf: pd.DataFrame) -> Iterator[dict]:
    """Rows in order of time as dicts, column by column; NaN is None."""
    pdf = pdf.sort_values([c for c in ("t_ns", "row_seq") if c in pdf], kind="stable")
    columns = [[None if x != x else x for x in v] if (v := pdf[c].tolist()) and pdf[c].dtype.kind == "f" else v for c in pdf]
    names = list(pdf.columns)
    for values in zip(*columns):
        yield dict(zip(names, values))


def fold(events: DataFrame, key: str, make: Callable[[], Step], schema: str) -> DataFrame:
    """Folds each key's events in order of time; ``schema`` is that of the outputs with the key first."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        step, state = make(), {}
        rows = [out for e in _events(pdf) if (out := step(state, e)) is not None]
        return pd.DataFrame([{key: pdf[key].iloc[0]} | r for r in rows], columns=names)

    return events.groupBy(key).applyInPandas(run, schema)


def fold_on_roads(events: DataFrame, roads: DataFrame, key: str, make: Callable[[Any], Step], schema: str) -> DataFrame:
    """The same beside the roads of each key (``seg_id, alat, alon, blat, blon, oneway, cls``), which ``make`` gets as a graph."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(pdf: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        from wayfold.operators.graph import RoadGraph

        step, state, rows = make(RoadGraph(segments[["seg_id", "alat", "alon", "blat", "blon", "oneway", "cls"]].itertuples(index=False, name=None))), {}, []
        for e in _events(pdf):
            out = step(state, e)
            rows += out if isinstance(out, list) else [] if out is None else [out]
        return pd.DataFrame([{key: pdf[key].iloc[0]} | r for r in rows], columns=names)

    return events.groupBy(key).cogroup(roads.groupBy(key)).applyInPandas(run, schema)


def fold_stream(events: DataFrame, key: str, make: Callable[[], Step], schema: str) -> DataFrame:
    """The same over a stream: the state of each key is kept as JSON between micro-batches and never times out.

    Events of one micro-batch are sorted; those that come in a later one than their successors are met late, as they are.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else {}
        step = make()
        parts = list(batches)
        rows = [{key: k[0]} | out for e in _events(pd.concat(parts)) if (out := step(state, e)) is not None] if parts else []
        kept.update((json.dumps(state),))
        yield pd.DataFrame(rows, columns=names)

    return events.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
