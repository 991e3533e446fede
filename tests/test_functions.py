"""Known answers of scalar functions, folds, graphs and estimators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, rotation, scalars
from wayfold.operators import align, gnss, graph, learning, spatial, windows
from wayfold.streaming import folds


def value(spark, expression, **columns):
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in columns.items()})
    return df.select(F.expr(expression).alias("v")).first()["v"]


def test_distances(spark):
    m = value(spark, geo.haversine("a", "b", "c", "d"), a=19.0760, b=72.8777, c=18.5204, d=73.8567)
    assert 115_000 < m < 125_000
    g = geo.geodesic(np.array([19.0760, 0.0]), np.array([72.8777, 0.0]), np.array([18.5204, 0.0]), np.array([73.8567, 1.0]))
    assert abs(g[0] - m) < 600 and abs(g[1] - 111_319.4908) < 1e-3


@pytest.mark.parametrize("a,b,want", [(350.0, 10.0, -20.0), (10.0, 350.0, 20.0), (180.0, 0.0, 180.0), (0.0, 180.0, -180.0), (-719.0, 0.0, 1.0)])
def test_bearing_difference(spark, a, b, want):
    assert value(spark, geo.bearing_difference("a", "b"), a=a, b=b) == pytest.approx(want)


def test_projection_on_nothing_is_null(spark):
    assert value(spark, geo.segment_fraction("a", "b", "a", "b", "a", "b"), a=1.0, b=2.0) is None


def test_rotation_round_trip(spark):
    q = dict(zip("xyzw", np.array([0.1, -0.4, 0.3, 0.85]) / np.linalg.norm([0.1, -0.4, 0.3, 0.85])))
    r = rotation.matrix("x", "y", "z", "w")
    back = rotation.quaternion(r)
    for k, v in q.items():
        assert value(spark, back[k], **{n: float(x) for n, x in q.items()}) == pytest.approx(v)


def test_softplus_is_stable(spark):
    assert value(spark, scalars.softplus("x"), x=800.0) == 800.0 and value(spark, scalars.softplus("x"), x=-800.0) == 0.0


def drive(step, events):
    state, out = {}, []
    for k, e in enumerate(events):
        if (o := step(state, {"t_ns": k} | e)) is not None:
            out.append(o)
    return state, out


def test_mount_offset_and_gates():
    level = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    turned = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg)), 0, -math.sin(math.radians(deg)), math.cos(math.radians(deg)), 0, 0, 0, 1]
    rotation_to = lambda deg, **g: dict(kind="rotation", r=turned(deg), **({"x": 0, "y": 0, "z": 9.8} | g))
    s, _ = drive(folds.compass(), [rotation_to(100)] + [dict(kind="fix", bearing=118 + (i % 3 - 1), speed=12, turn=0) for i in range(20)])
    assert s["offset"] == pytest.approx(18, abs=0.5)
    s, _ = drive(folds.compass(), [rotation_to(350)] + [dict(kind="fix", bearing=10, speed=12, turn=0) for _ in range(20)])
    assert s["offset"] == pytest.approx(20, abs=0.5)
    s, _ = drive(folds.compass(), [rotation_to(0)] + [dict(kind="fix", bearing=10, speed=2, turn=0)] * 30 + [dict(kind="fix", bearing=10, speed=9, turn=20)] * 30)
    assert s["n"] == 0
    s, _ = drive(folds.compass(), [rotation_to(0)] + [dict(kind="fix", bearing=5, speed=9, turn=0)] * 5 + [dict(kind="rotation", r=level, x=0, y=9.8, z=0)])
    assert s["n"] == 0 and s["axis"] == "z"
    _, out = drive(folds.compass(), [dict(kind="yaw", rate=0.1, dt=0.1)])
    assert out[0]["heading"] is None


def test_gyro_is_bounded_by_the_compass_unless_disturbed():
    start = [dict(kind="magnetometer", x=40, y=0, z=0), dict(kind="rotation", r=[1, 0, 0, 0, 1, 0, 0, 0, 1], x=0, y=0, z=9.8)] + [dict(kind="fix", bearing=0, speed=12, turn=0)] * 20
    _, out = drive(folds.compass(), start + [dict(kind="yaw", rate=math.radians(2), dt=0.1)] * 600)
    assert abs(folds.wrap180(out[-1]["heading"])) < 10
    _, out = drive(folds.compass(), start + [dict(kind="magnetometer", x=80, y=0, z=0)] + [dict(kind="yaw", rate=math.radians(1), dt=0.1)] * 100)
    assert out[-1]["heading"] == pytest.approx(10, abs=0.2)


def test_kinematics_of_the_integrator():
    s, _ = drive(folds.strapdown(), [dict(kind="anchor", lat=10.0, lon=10.0, speed=5.0, bearing=90.0)])
    assert s["speed"] == 5 and math.degrees(s["heading"]) == pytest.approx(90)
    step = folds.strapdown()
    step(s, dict(kind="yaw", t_ns=1, rate=math.radians(45), dt=1.0))
    assert math.degrees(s["heading"]) == pytest.approx(135)
    step(s, dict(kind="model", t_ns=2, speed=10.0, weight=0.5))
    assert s["speed"] == pytest.approx(7.5)
    before = s["heading"]
    step(s, dict(kind="road", t_ns=3, bearing=140.0, gain=0.8))
    assert 0 < math.degrees(s["heading"] - before) <= 4 + 1e-9


def test_late_acceleration_moves_the_clock_back():
    level = dict(kind="rotation", r=[1, 0, 0, 0, 1, 0, 0, 0, 1])
    push = lambda ms: dict(kind="accel", t_ns=ms * 1_000_000, x=0.0, y=1.0, z=9.80665)
    start = [level, dict(kind="anchor", lat=0.0, lon=0.0)]
    s, out = drive(folds.strapdown("eval"), start + [push(10), push(20), push(80), push(90)])
    assert len(out) == 1 + 2 and s["v"][1] == pytest.approx(0.02)  # 60 ms are dropped, yet the clock goes on
    s, _ = drive(folds.strapdown("eval"), start + [push(10), push(20), push(15), push(40)])
    assert s["v"][1] == pytest.approx(0.01 + 0.025)


def test_attitude():
    still = dict(kind="sample", gyro=[0, 0, 0], accel=[0, 0, 9.80665], dt=0.1)
    _, out = drive(folds.attitude(), [still] * 400)
    assert out[-1]["up_z"] == pytest.approx(1, abs=1e-3) and out[-1]["converged"]
    _, out = drive(folds.attitude(), [still | {"gyro": [0, 0, math.radians(20)]}] * 300)
    assert folds.wrap180(out[-1]["heading"] - 120) == pytest.approx(0, abs=0.5)


def test_matcher_prefers_the_road_driven_along():
    near = [dict(seg=1, lat=0.0, lon=0.0, dist=5.0, bearing=0.0, oneway=False), dict(seg=2, lat=0.0, lon=0.0, dist=4.0, bearing=90.0, oneway=False)]
    _, out = drive(folds.matcher(), [dict(kind="fix", lat=0.0, lon=0.0, course=3.0, speed=10.0, sigma=40.0, near=near)] * 3)
    assert [o["seg"] for o in out] == [1, 1, 1] and out[-1]["confidence"] > 0.9
    _, out = drive(folds.matcher(), [dict(kind="fix", lat=0.0, lon=0.0, course=3.0, speed=10.0, sigma=5.0, near=near)])
    assert not out


def lattice(n=4, step=0.001):
    rows = [(10 * i + j, i * step, j * step, i * step, (j + 1) * step) for i in range(n) for j in range(n - 1)]
    return rows + [(100 + 10 * i + j, i * step, j * step, (i + 1) * step, j * step) for i in range(n - 1) for j in range(n)] + [(999, 0.0, -step, 0.0, 0.0)]


def test_road_graph():
    g = graph.RoadGraph(lattice())
    metres, path = g.route((0, 0.0), (132 if 132 in g.ends else 123, 0.0))
    assert 0 < metres < 1000 and path[0] == 0
    assert g.route((0, 10.0), (0, 60.0))[0] == 50.0
    assert g.between((0, 0.0), (1, 0.0), 500) == pytest.approx(g.length[0])
    assert math.isinf(g.between((0, 0.0), (32, 0.0), 50))
    out = g.advance([(0, 0.0, 1, 0.0)], 150.0)
    assert 1 < len(out) <= 8 and all(0 <= o[1] <= g.length[o[0]] for o in out)
    assert g.advance([(999, 50.0, -1, 0.0)], 500.0)[0][1] == pytest.approx(g.length[999])  # a dead end stops


def test_interpolation_holds_its_ends(spark):
    grid = spark.createDataFrame([(1, float(t)) for t in (-1, 0, 1, 3, 9)], "k int, t double")
    samples = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 20.0), (1, 1.0, None), (1, 4.0, 0.0)], "k int, t double, v double")
    got = [r["v"] for r in align.interpolate(grid, samples, "k", "t", "v").orderBy("t").collect()]
    assert got == [10.0, 10.0, 15.0, 10.0, 0.0]
    got = [r["v"] for r in align.interpolate(grid, samples, "k", "t", "v", inside_only=True).orderBy("t").collect()]
    assert got == [None, 10.0, 15.0, 10.0, None]


def test_gradient_is_numpys(spark):
    t = np.array([0.0, 1.0, 1.5, 4.0, 4.2])
    x = t**2
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, x)], "k int, t double, x double")
    got = [r["g"] for r in df.select("t", windows.gradient("x", "t", windows.by("k", "t")).alias("g")).orderBy("t").collect()]
    assert got == pytest.approx(np.gradient(x, t).tolist())


def test_lag_and_receptive_field():
    rng = np.random.default_rng(1)
    x = rng.normal(size=80)
    assert learning.correlation_lag(x[7:71], x[:64])[0] == -7 and learning.correlation_lag(x[:64], x[7:71])[0] == 7
    assert learning.receptive_field([1, 2, 4, 8, 16, 32]) == 253


def test_satellite_speed(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, float(a), float(b), float(c), 0.6, 0.8, float(10 * (0.6 * a + 0.8 * b) + 2)) for i, (a, b, c) in enumerate(rng.normal(size=(6, 3)))]
    df = spark.createDataFrame(rows, "e int, sat int, le double, ln double, lu double, ue double, un double, rate double")
    for mode in ("nhc", "flat", "full"):
        assert gnss.solve(df, ["e"], mode).first()["speed"] == pytest.approx(10)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, t, t, "x", float((37 * t + 11 * k) % 360)) for t in range(40) for k in range(3)]
    schema = "k long, t_ns long, row_seq long, kind string, deg double"
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] >= 20) == part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = folds.fold(spark.read.parquet(f"{tmp_path}/in"), "k", folds.smoothed_circle, "k long, t_ns long, deg double").collect()
    one = folds.fold_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "k", folds.smoothed_circle, "k long, t_ns long, deg double")
    q = one.writeStream.format("memory").queryName("smooth").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("smooth").collect())) == sorted(map(tuple, batch))


def test_nearest_state_looks_at_every_segment(spark):
    # 30 roads across the course are nearer than the one along it
    roads = [(i, 22.3 + 1e-6 * i, 87.2995, 22.3 + 1e-6 * i, 87.3005) for i in range(1, 31)] + [(99, 22.2995, 87.3003, 22.3005, 87.3003)]
    seg = spark.createDataFrame(roads, "seg_id long, alat double, alon double, blat double, blon double")
    point = spark.createDataFrame([(1, 22.3, 87.3, 0.0)], "k int, lat double, lon double, bearing double")
    best = spatial.nearest_state(point, seg, ["k"], 150.0).first()
    assert (best["seg_id"], best["dir"]) == (99, 1) and 25 < best["cost"] < 40
    assert spatial.candidates(point, seg, ["k"], 150.0).count() == 24
