"""Walks, switches, replays, recomputed sessions, the network and training sets against hand-made cases and plainer versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import corridor, gnss, learning, reports, tcn, training
from wayfold.operators.graph import RoadGraph
from wayfold.streaming import folds, tracking

D = 1 / 111_132.0


def straight(n=6, lat=0.0):
    """A road of n pieces of 100 m to the east along the equator, with a branch to the north after the third."""
    rows = [(k, lat, 100 * k * D, lat, 100 * (k + 1) * D, False, "primary") for k in range(n)]
    return RoadGraph([*rows, (50, lat, 300 * D, lat + 100 * D, 300 * D, False, "residential")])


def run(step, events):
    state, out = {}, []
    for e in events:
        got = step(state, e)
        out += got if isinstance(got, list) else [] if got is None else [got]
    return out


def tick(t, x, unaided=True, drift=0.0, y=0.0, course=90.0):
    return dict(kind="tick", t_ns=t * 10**9, lat=y * D, lon=x * D, course=course, unaided=unaided, drift=drift)


def test_walk_takes_over_and_ends_with_aid():
    out = run(tracking.along_road(straight()), [tick(k, 20 * k, drift=20.0 * k, y=k) for k in range(10)] + [tick(10, 200, False)] + [tick(11 + k, 200, drift=0.0) for k in range(3)])
    assert [o["t_ns"] // 10**9 for o in out] == [4, 5, 6, 7, 8, 9]  # four seconds and 60 m
    assert all(abs(o["lat"]) < 1e-9 for o in out)  # on the road, whatever the integrator's drift across it
    assert out[0]["lon"] / D == pytest.approx(sum(math.hypot(20, 1) for _ in range(4)), abs=0.5)
    assert out[0]["confidence"] == 1.0 and out[0]["correction"] == pytest.approx(4, abs=0.5) and out[0]["heading"] == pytest.approx(90)


def test_walk_needs_a_road_near():
    assert run(tracking.along_road(straight()), [tick(k, 20 * k, drift=20.0 * k, y=200) for k in range(10)]) == []
    assert tracking.tracked(straight(), 300 * D, 0.0, 90.0, [10.0]) is None
    places = tracking.tracked(straight(), 0.0, 10 * D, 90.0, [50.0, 100.0, 100.0])
    assert [round(lon / D) for _, lon in places] == [60, 160, 260]


def test_fork_has_two_routes():
    g = straight()
    walk = g.advance([g.nearest(0.0, 250 * D, 90.0, 80.0)], 100.0)
    assert {(s, w) for s, _, w, _ in walk} == {(3, 1), (50, 1)} and walk[0][0] == 3  # straight on costs no turn
    assert g.nearest(0.0, 250 * D, 270.0, 80.0)[2] == -1
    assert len(g.bridge((0.0, 10 * D), (50 * D, 300 * D))) == 3  # three junctions on the way


def test_route_matcher_won_t_leap_between_unconnected_roads():
    g = RoadGraph([(1, 0.0, 0.0, 0.0, 400 * D), (2, 30 * D, 0.0, 30 * D, 400 * D)])
    track = [(10 * k, 0.0 if k < 5 else 17.0) for k in range(12)]  # from then on it is nearer to the other road
    events = [dict(kind="fix", t_ns=k, lat=y * D, lon=x * D, course=90.0, speed=10.0, sigma=60.0, near=g.near(y * D, x * D, 120.0)) for k, (x, y) in enumerate(track)]
    assert {o["seg"] for o in run(folds.matcher("eval", graph=g), events)} == {1}
    assert folds.MATCHER["live"]["least_budget"] == 12.0


def test_mode_switch():
    s = 10**9
    events = [dict(kind="tick", t_ns=0), dict(kind="fix", t_ns=s, healthy=True), *(dict(kind="tick", t_ns=k * s) for k in (2, 6, 7, 9)), dict(kind="fix", t_ns=10 * s, healthy=False), dict(kind="tick", t_ns=10 * s), dict(kind="fix", t_ns=11 * s, healthy=True), dict(kind="tick", t_ns=11 * s), dict(kind="tick", t_ns=12 * s, forced=True)]
    assert [(o["unaided"], o["seconds"]) for o in run(tracking.mode_switch(), events)] == [(True, 0.0), (False, 0.0), (False, 0.0), (True, 0.0), (True, 2.0), (True, 3.0), (False, 0.0), (True, 0.0)]


def test_feedback_takes_the_nearer_direction_and_four_degrees_at_most():
    assert tracking.feedback(90, 95, 10, 0.9) == pytest.approx(0.35 * 5)
    assert tracking.feedback(90, 275, 10, 0.9) == pytest.approx(0.35 * 5)
    assert tracking.feedback(90, 150, 10, 0.9) == 4.0 and tracking.feedback(90, 30, 10, 0.9) == -4.0
    assert tracking.feedback(90, 95, 1.9, 0.9) == tracking.feedback(90, 95, 10, 0.59) == 0.0


def test_back_pressure():
    out = run(tracking.back_pressure(1.0), [dict(kind="call", t_ns=k * 10**8) for k in range(30)])
    assert max(o["pending"] for o in out) == 8 and out[-1]["dropped"] == 30 - 8 - 2


def test_replay_and_kinematics():
    start = dict(kind="start", t_ns=0, lat=0.0, lon=0.0, speed=0.0, bearing=90.0)
    out = run(tracking.replay(), [start, *(dict(kind="out", t_ns=k, mu=10.0, logit=-3.0, up=0.0) for k in range(100)), dict(kind="out", t_ns=100, mu=10.0, logit=3.0, up=1.0)])
    assert out[-1]["lon"] / D == pytest.approx(100, abs=0.01) and out[-1]["speed"] == 0 and out[-1]["heading"] == 90
    east = dict(kind="accel", x=1.0, y=0.0, z=10.2)
    out = run(tracking.kinematic(), [start, *(east | dict(t_ns=k * 10**8) for k in range(1, 101))])
    assert out[-1]["speed"] == pytest.approx(0.01 + 0.1 * (out[-1]["t_ns"] / 1e8 - 1)) and out[-1]["lat"] == pytest.approx(0, abs=1e-9)
    assert all(b["t_ns"] - a["t_ns"] > 500_000_000 for a, b in zip(out[1:], out[2:]))
    calm = run(tracking.adaptive(), [dict(kind="sample", t_ns=k, up=0.0, ae=0.0, an=0.0, gps=None, logit=None, model=None, speed=0.5, bearing=0.0) for k in range(5)])
    assert calm[-1]["speed"] == 0.0
    turned = run(tracking.adaptive(), [dict(kind="sample", t_ns=k, up=-math.pi / 20, ae=0.0, an=0.0, gps=None, logit=None, model=10.0, speed=10.0, bearing=0.0) for k in range(101)])
    assert turned[-1]["east"] > 40  # clockwise turns from north lead east


def test_recomputed_session_follows_the_road():
    g = straight(20)
    still = dict(kind="rotation", r=[1, 0, 0, 0, 1, 0, 0, 0, 1])
    events = [dict(kind="anchor", t_ns=0, lat=4 * D, lon=0.0, speed=10.0, bearing=90.0, acc=3.0), still | dict(t_ns=1)]
    for k in range(1, 400):
        events += [dict(kind="gyro", t_ns=k * 40_000_000, x=0.2, y=0.0, z=0.0), dict(kind="accel", t_ns=k * 40_000_000 + 1, x=0.0, y=0.3, z=9.81)]
    out = run(tracking.recompute(g), events)
    tracks = {name: [o for o in out if o["track"] == name] for name in ("recomputed", "matched")}
    assert [o["place"] for o in tracks["matched"]] == list(range(len(tracks["matched"])))
    assert len(tracks["recomputed"]) == 31  # each 13th acceleration
    assert all(abs(o["lat"]) < 1e-9 for o in tracks["matched"])
    assert tracks["recomputed"][-1]["lon"] / D == pytest.approx(160, rel=0.1)


def test_integrator_has_the_scale_of_its_place():
    step, s = folds.strapdown("eval", max_dt=1.0), {}
    step(s, dict(kind="anchor", t_ns=0, lat=60.0, lon=10.0, speed=10.0, bearing=0.0))
    step(s, dict(kind="rotation", t_ns=0, r=[1, 0, 0, 0, 1, 0, 0, 0, 1]))
    for k in range(1, 12):
        out = step(s, dict(kind="accel", t_ns=k * 10**9, x=0.0, y=0.0, z=9.80665 + 0.2 * (-1) ** k))
    p = math.radians(60)
    assert (out["lat"] - 60) * (111132.92 - 559.82 * math.cos(2 * p) + 1.175 * math.cos(4 * p)) == pytest.approx(100, abs=1e-6)


def test_network_equals_a_plain_one():
    w = tcn.drawn_weights(5, stem=4, channels=(4, 6, 6))
    net, rng = tcn.Network(w), np.random.default_rng(1)
    x = rng.normal(0, 1, (2, 6, 30))

    def conv(v, k, b, pad, d):  # one number at a time
        o, n = k.shape[0], v.shape[1] + sum(pad) - (k.shape[2] - 1) * d
        out = np.zeros((o, n))
        for c in range(o):
            for t in range(n):
                out[c, t] = (0 if b is None else b[c]) + sum(k[c, i, j] * v[i, t + j * d - pad[0]] for i in range(v.shape[0]) for j in range(k.shape[2]) if 0 <= t + j * d - pad[0] < v.shape[1])
        return out

    def norm(v, name):
        return np.stack([(v[c] - w[f"{name}.running_mean"][c]) / math.sqrt(w[f"{name}.running_var"][c] + 1e-5) * w[f"{name}.weight"][c] + w[f"{name}.bias"][c] for c in range(len(v))])

    got = net.forward(x)
    for b in range(2):
        v = np.stack([(x[b, c] - w["input_norm.running_mean"][c]) / math.sqrt(w["input_norm.running_var"][c]) for c in range(6)])
        v = np.maximum(norm(conv(v, w["stem.0.weight"], None, (3, 3), 1), "stem.1"), 0)
        for k in range(3):
            p, reach = f"blocks.{k}", 2 * 2**k
            skip = conv(v, w[f"{p}.skip.weight"], w[f"{p}.skip.bias"], (0, 0), 1) if f"{p}.skip.weight" in w else v
            y = np.maximum(norm(conv(v, w[f"{p}.conv1.weight"], w[f"{p}.conv1.bias"], (reach, 0), 2**k), f"{p}.bn1"), 0)
            v = np.maximum(norm(conv(y, w[f"{p}.conv2.weight"], w[f"{p}.conv2.bias"], (reach, 0), 2**k), f"{p}.bn2") + skip, 0)
        mean = v.mean(axis=1)
        way = w["head_disp.weight"] @ mean + w["head_disp.bias"]
        assert got["mu"][b] == pytest.approx(math.log1p(math.exp(way[0]))) and got["logvar"][b] == pytest.approx(min(4, max(-6, way[1])))
        assert got["yaw_rate"][b] == pytest.approx((w["head_yaw.weight"] @ mean + w["head_yaw.bias"])[0])
        assert got["a_seq"][b] == pytest.approx((w["head_a_seq.weight"][:, :, 0] @ v + w["head_a_seq.bias"][:, None])[0])
    assert tcn.Geometry.of({"stem.0.weight": (8, 6, 7)}) is None and net.geometry.receptive_field() == 1 + 2 * 2 * 7


def test_split_is_greedy_and_pins_are_exclusive():
    sizes = [("a", 50), ("b", 30), ("c", 10), ("d", 6), ("e", 4)]
    split = training.greedy_split(sizes)
    assert split["a"] == "train" and {split[x] for x in "bcde"} >= {"val", "test"}
    pinned = training.greedy_split(sizes, ("e",))
    assert pinned["e"] == "test" and "test" not in [pinned[x] for x in "abcd"]


def test_two_alignments(spark):
    rng = np.random.default_rng(4)
    n, late = 900, 7
    turn, speed = rng.normal(0, 5, n + late), 10 + rng.normal(0, 3, n + late)
    rows = [(run, i, float(speed[i]), 0.0, 0.0, 9.8, 0.0, 0.0, math.radians(float(turn[i])) * sign, 22.0 + off * D, 87.0, float(speed[i + late]), float(turn[i + late]), 22.0, 87.0) for run, sign, off in (("good", 1, 10), ("far", 1, 90)) for i in range(n)]
    d = spark.createDataFrame(rows, "run string, i int, speed double, ax double, ay double, az double, gx double, gy double, gz double, slat double, slon double, vspeed double, vyaw double, vlat double, vlon double")
    got = {r["run"]: r for r in training.aligned_runs(d, "run", "i").collect()}
    assert got["good"]["lag"] == late and got["good"]["fine"] == 0 and got["good"]["reason"] is None and got["good"]["sign"] == 1
    assert got["far"]["reason"] == "position offset" and got["far"]["sign"] == 1 and got["far"]["offset"] == pytest.approx(90, abs=0.1)
    short = training.aligned_runs(d.where("i < 300"), "run", "i").collect()
    assert {r["reason"] for r in short} == {"too short after the first alignment"}


def test_windows_of_training_sets(spark):
    rows = [("r", i, float(i), float(i % 7), None if i == 33 else 1.0 + i, 0.1, None) for i in range(60)]
    d = spark.createDataFrame(rows, "run string, i int, a double, g double, speed double, yaw_rate double, lateral double")
    s = training.run_set(d, "run", "i", ["a"], ["g"], "none", 20, 10).orderBy("start").collect()
    assert [r["start"] for r in s] == [0, 10, 20, 30]  # 40 would be the last full one
    assert s[0]["window"][0] == [float(i) for i in range(20)] and s[0]["speed"] == 20.0 and s[0]["lateral"] == 0.0
    freed = training.run_set(d, "run", "i", ["a"], ["g"], "accel", 20, 10).orderBy("start").first()
    assert freed["window"][0][0] == -29.5 and freed["window"][1][:3] == [0.0, 1.0, 2.0]  # the median: it never stands
    p = training.phone_set(d.withColumns({"t": F.col("i") / 10, "bearing": F.col("i") * 2.0}), "run", "i", "t", ["a", "g"], 10, 5).orderBy("start").collect()
    assert [r["start"] for r in p] == [s for s in range(0, 50, 5) if s + 10 != 33] and p[0]["speed"] == 11.0 and p[0]["yaw_rate"] == pytest.approx(math.radians(20), abs=1e-6)
    assert p[0]["lateral"] == pytest.approx(11 * math.radians(20), abs=1e-6)


def test_perfect_channels_have_no_drift(spark):
    rng = random.Random(3)
    rows, e, n, h = [], 0.0, 0.0, 30.0
    for i in range(700):
        yaw, v = rng.uniform(-0.2, 0.2), rng.uniform(5, 15)
        h = (h + math.degrees(yaw) * 0.1) if i else h
        e, n = e + v * math.sin(math.radians(h)) * 0.1, n + v * math.cos(math.radians(h)) * 0.1
        rows.append(("s", i, e, n, h % 360, v, yaw if i else 0.0, v, yaw, yaw + 0.05, 1))
    d = spark.createDataFrame(rows, "s string, i int, east double, north double, heading double, speed double, yaw double, model_speed double, model_yaw double, gyro_yaw double, sgn int")
    got = {(r["speeds"], r["turns"]): r for r in training.swapped_channels(d, ["s"], "i", "sgn").collect()}
    assert len(got) == 7
    assert got["truth", "heading"]["percent"] < 0.6 and got["truth", "truth"]["percent"] < 0.6 and got["truth", "gyro"]["percent"] > 5
    drift = training.checkpoint_drift(d, "s", "i", "sgn", 100, 100, 350, 300, 10.0).collect()
    assert len(drift) == 3 and all(r["percent"] < 2.5 for r in drift)  # the gyro's bias is measured before each


def test_boxes_are_halved_as_by_recursion(spark):
    def halves(s, w, n, e, most):
        if (n - s) * (e - w) <= most:
            return [(s, w, n, e)]
        if n - s >= e - w:
            return halves(s, w, (s + n) / 2, e, most) + halves((s + n) / 2, w, n, e, most)
        return halves(s, w, n, (w + e) / 2, most) + halves(s, (w + e) / 2, n, e, most)

    rng = random.Random(1)
    boxes = [(k, 0.0, 0.0, rng.uniform(0.1, 9), rng.uniform(0.1, 9)) for k in range(40)] + [(99, 0.0, 0.0, 1.0, 1.0)]
    got = corridor.halved(spark.createDataFrame(boxes, "id int, south double, west double, north double, east double"), 1.0).collect()
    want = sorted((k, *(round(x, 9) for x in b)) for k, *box in boxes for b in halves(*box, 1.0))
    assert sorted((r["id"], *(round(r[c], 9) for c in ("south", "west", "north", "east"))) for r in got) == want


def test_corridor_leaves_small_roads_to_the_ends(spark):
    roads = [(1, 22.0, 87.0, "residential"), (2, 22.15, 87.0, "residential"), (3, 22.15, 87.0, "primary"), (4, 22.3, 87.0, "residential"), (5, 22.3, 87.0, "footway"), (6, 25.0, 87.0, "primary")]
    s = spark.createDataFrame([(i, a, b, a + 0.0005, b, c) for i, a, b, c in roads], "seg_id int, alat double, alon double, blat double, blon double, cls string")
    q = spark.createDataFrame([(1, 22.0, 87.0, 22.3, 87.0), (2, 22.0, 87.0, 22.001, 87.0)], "req int, alat double, alon double, blat double, blon double")
    got = {(r["req"], r["seg_id"]) for r in corridor.corridors(q, s).collect()}
    assert got == {(1, 1), (1, 3), (1, 4), (2, 1)}


def test_outages_that_can_be_scored(spark):
    fixes = spark.createDataFrame([("a", 10.0 * k, 1.0 if k == 2 else 5.0) for k in range(10)], "s string, t double, speed double")
    starts = spark.createDataFrame([("a", t) for t in (0.0, 5.0, 15.0, 25.0, 55.0, 65.0, 85.0, 95.0)], "s string, t double")
    got = reports.admissible_outages(starts, fixes, "s", "t", 30.0, 3.0).orderBy("t").collect()
    assert [r["t"] for r in got] == [0.0, 5.0, 25.0, 55.0]


def test_augmented_windows_turn_in_the_plane(spark):
    d = spark.createDataFrame([(k, [1.0, 2.0], [3.0, 4.0]) for k in range(20)], "k int, x array<double>, y array<double>")
    for r in learning.augmented(d, "k", 0.0, 0.0).collect():
        assert [math.hypot(a, b) for a, b in zip(r["x"], r["y"])] == pytest.approx([math.hypot(1, 3), math.hypot(2, 4)])


def test_satellite_sweep(spark):
    e = spark.createDataFrame([("a", k, 600.0 * k, 22.3, 87.3, 10.0, 40.0) for k in range(12)], "session string, seq int, t_s double, lat double, lon double, speed double, bearing double")
    got = {(r["strategy"], r["mode"], r["n"]): r for r in gnss.sweep(e, 3).collect()}
    assert len(got) == 3 * 10 and all(r["kept"] <= r["total"] == 36 for r in got.values() if r["n"] == 1)
    low, high = got["dot", "coast", 1], got["elevation", "coast", 1]
    assert low["rmse"] < 1.0 and low["kept"] >= high["kept"]


def plain_sweep(spark, epochs, trials, most):
    """The sweep by ``visible``, ``chosen`` and ``solve``, each a pass of its own over rows of single satellites."""

    def noise(salt, *keys):
        u = lambda k: (F.pmod(F.xxhash64(*keys, F.lit(salt), F.lit(k)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
        return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))

    n = epochs.groupBy("session").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 40)).alias("every"))
    sats = gnss.visible(gnss.constellation(spark, epochs.join(n, "session").where("seq % every = 0").drop("every"), "t_s"), mask_deg=15.0)
    sats = sats.withColumn("dot", F.col("le") * F.sin(F.radians("bearing")) + F.col("ln") * F.cos(F.radians("bearing")))
    sats = sats.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("drift", noise(1, "session", "seq", "trial"))
    sats = sats.withColumn("rate", F.col("dot") * F.col("speed") + F.col("drift") + 0.3 * noise(2, "session", "seq", "trial", "sat"))
    course = F.radians(F.col("bearing") + 3.0 * noise(3, "session", "seq", "trial"))
    sats = sats.withColumns({"ue": F.sin(course), "un": F.cos(course)}).localCheckpoint()
    epoch, out = ["session", "seq", "trial"], {}
    for strategy in ("elevation", "dot", "random"):
        ranked = gnss.chosen(sats, epoch, strategy, most, "place").localCheckpoint()
        for n in range(1, most + 1):
            first = ranked.where(F.col("place") <= n)
            full = first.join(first.groupBy(*epoch).count().where(F.col("count") == n).drop("count"), epoch).withColumnRenamed("speed", "truth").localCheckpoint()
            truth = full.where("place = 1").select(*epoch, "truth")
            for mode, need in gnss.NEEDS.items():
                if n >= need:
                    got = gnss.solve(full.withColumn("rate", F.col("rate") - F.col("drift")) if mode == "coast" else full, epoch, mode).join(truth, epoch)
                    e = F.when(F.col("speed").isNotNull() & (F.col("sigma") * 0.3 <= 2.0), F.col("speed") - F.col("truth"))
                    r = got.agg(F.count("*").alias("total"), F.count(e).alias("kept"), F.sqrt(F.avg(e * e)).alias("rmse")).first()
                    if r["total"]:
                        out[strategy, mode, n] = (r["total"], r["kept"], r["rmse"])
    return out


SWEPT = "session string, seq int, t_s double, lat double, lon double, speed double, bearing double"


def swept(d, trials, most):
    return {(r["strategy"], r["mode"], r["n"]): (r["total"], r["kept"], r["rmse"]) for r in gnss.sweep(d, trials, most).collect()}


def test_satellite_sweep_is_the_plain_one(spark):
    rng = random.Random(4)
    tracks = {"a": 97, "b": 30, "far": 9, None: 5}
    rows = [[s, k, 977.0 * k, 80.0 if s == "far" else rng.uniform(-60, 60), rng.uniform(-180, 180), rng.uniform(0, 30), rng.uniform(0, 360)] for s, m in tracks.items() for k in range(m)]
    for k, column in ((3, 5), (100, 5), (101, 6), (102, 3), (103, 4), (104, 2), (105, 1)):
        rows[k][column] = None
    d = spark.createDataFrame(rows, SWEPT).repartition(3)
    got, want = swept(d, 2, 5), plain_sweep(spark, d, 2, 5)
    assert got.keys() == want.keys() and len(got) == 3 * 14
    for k, (total, kept, rmse) in want.items():
        assert got[k] == (total, kept, pytest.approx(rmse, rel=1e-6))
    for row in rows:
        row[5] = float("nan") if row[5] is None else row[5]
    assert swept(spark.createDataFrame(rows, SWEPT), 2, 5) == {k: (t, n, pytest.approx(e)) for k, (t, n, e) in got.items()}
    assert not swept(d.where("false"), 2, 5)


def test_satellite_sweep_deals_out_its_epochs_once(spark):
    d = spark.createDataFrame([("a", 0, 0.0, 22.3, 87.3, 10.0, 40.0)], SWEPT)
    plan = gnss.sweep(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("MapInPandas") == 1 and "Join" not in plan  # tracks, and the sums


def test_estimates_of_the_sweep_are_those_of_the_solver(spark):
    rng = np.random.default_rng(8)
    x, y, z, rate = rng.normal(size=(4, 60, 4))
    size = np.sqrt(x * x + y * y + z * z)
    x, y, z = x / size, y / size, z / size
    for k in range(10):  # heights that are equal, or nearly so, beside the clock
        z[k] = 0.5 + 10.0 ** -(k + 1) * np.arange(4) if k else 0.5
    x[10], y[10], z[10], x[11] = x[10, 0], y[10, 0], z[10, 0], 0.0
    course, drift = rng.uniform(0, 6, 60), np.zeros(60)
    d = spark.createDataFrame([(e, *map(float, (x[e, k], y[e, k], z[e, k], rate[e, k], np.sin(course[e]), np.cos(course[e])))) for e in range(60) for k in range(4)], "e long, le double, ln double, lu double, rate double, ue double, un double")
    with np.errstate(all="ignore"):
        got = {mode: (speed, good) for n, mode, speed, good in gnss._estimates(x, y, z, rate, drift, np.sin(course), np.cos(course), 5.0) if n == 4}
    assert got["full"][1][1] and not got["full"][1][[0, 9, 10]].any()
    for mode, (speed, good) in got.items():
        want = {r["e"]: r["speed"] for r in gnss.accepted(gnss.solve(d, ["e"], mode), 5.0).where("speed IS NOT NULL").collect()}
        assert sorted(want) == np.flatnonzero(good).tolist()
        assert [want[e] for e in sorted(want)] == pytest.approx(speed[good].tolist(), rel=1e-6)


def test_geodesic_is_not_the_sphere(spark):
    d = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (50.0, 10.0, 50.0, 10.0)], "a double, b double, c double, d double")
    got = [r[0] for r in d.select(reports.geodesic_metres("a", "b", "c", "d")).collect()]
    assert got == pytest.approx([111319.491, 110574.389, 0.0], abs=0.01)


def test_compared_models_sum_along_the_track(spark):
    e = [1e16, -1e16, 3.0, 0.0, 0.0, 0.0]  # 3 in this order, else 4 or 2
    rows = [(1, k, 0.0, x, 0.0, 0.0, 0.0, True) for k, x in enumerate(e)]
    d = spark.createDataFrame(rows[::-1], "s long, i long, speed double, model double, heading double, east double, north double, drive boolean").repartition(3, "i")
    assert training.compared_models(d, "s", "i", {"m": "model"}, 2, 2).first()["bias"] == 3.0 / 6
