"""Readers and writers on files and odd rows; spatial joins away from the equator."""

import json
import math
import random

from pyspark.sql import functions as F

from wayfold.operators import spatial, windows
from wayfold.sources import readers, sinks


def test_lines_come_in_order_from_splits(spark, tmp_path):
    for name, n in (("s1", 3000), ("s2", 10)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "imu.csv").write_text("".join(f"{i},accel,3,{i}.5\r\n" for i in range(n)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.lines(spark, f"{tmp_path}/*/imu.csv")
        assert rows.rdd.getNumPartitions() > 3
        got = readers.parse_imu(rows).orderBy("session", "block", "row_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["t_ns"] for r in got if r["session"] == "s1"] == list(range(3000)) and sum(r["session"] == "s2" for r in got) == 10


def test_sets_and_metadata_are_rewritten(spark, tmp_path):
    w = spark.createDataFrame([(1, [[1.0, 2.0]], [0.5])], "run int, window array<array<double>>, target array<double>")
    for channels in (1, 6):
        sinks.tensor_set(w, f"{tmp_path}/set", frame="earth", channels=channels)
    assert json.loads(spark.read.text(f"{tmp_path}/set/meta").first()[0]) == {"channels": 6, "frame": "earth"}
    assert spark.read.parquet(f"{tmp_path}/set/windows").first()["window"] == [[1.0, 2.0]]
    s = spark.createDataFrame([("a", "1.0", None, None, None), ("b", "1.0", 3.5, 7, 8)], "session_id string, app_version string, duration_s double, imu_samples long, gps_fixes long")
    m = {r["session_id"]: json.loads(r["json"]) for r in sinks.session_metadata(s).collect()}
    assert "summary" not in m["a"] and m["b"]["summary"]["imu_samples"] == 7
    for _ in range(2):
        sinks.rewrite(s, f"{tmp_path}/meta")
    assert spark.read.json(f"{tmp_path}/meta").count() == 2


def test_short_model_sessions_go(spark):
    model = spark.createDataFrame([("a", float(i), 1.0) for i in range(20)] + [("b", float(i), 1.0) for i in range(9)] + [("c", float(i), float("nan")) for i in range(20)], "s string, t double, mu double")
    fixes = spark.createDataFrame([(s, 4.0 + i, float(i)) for s in "abc" for i in range(12)], "s string, t double, speed double")
    got = readers.model_pairs(model, fixes, "s", "t").orderBy("t").collect()
    assert {r["s"] for r in got} == {"a"} and [r["truth"] for r in got] == [float(i) for i in range(12)]


def test_smallest_map_over_whole_degrees(spark):
    maps = spark.createDataFrame([("big", -10.0, -10.0, 30.0, 30.0), ("small", 0.5, 0.5, 1.5, 1.5), ("also", 0.5, 0.5, 1.5, 1.5)], "name string, south double, west double, north double, east double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, -9.5, 29.9), (3, 40.0, 0.0), (4, 0.4, 1.0)], "p int, lat double, lon double")
    assert {r["p"]: r["map"] for r in readers.covering(maps, points, "p").collect()} == {1: "also", 2: "big", 4: "big"}


def test_candidates_far_north(spark):
    rng = random.Random(2)
    segs = [(i, 69.0 + rng.uniform(0, 0.01), 20.0 + rng.uniform(0, 0.03)) for i in range(300)]
    segs = [(i, a, b, a + rng.uniform(-0.002, 0.002), b + rng.uniform(-0.006, 0.006)) for i, a, b in segs]
    points = [(i, 69.0 + rng.uniform(0, 0.01), 20.0 + rng.uniform(0, 0.03)) for i in range(40)]
    got = spatial.candidates(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(segs, "seg_id int, alat double, alon double, blat double, blon double"), ["p"], 150.0, most=None).select("p", "seg_id").collect()

    def near(lat, lon, a, b, c, e):
        k = math.cos(math.radians(lat))
        ax, ay, bx, by = (b - lon) * 111132 * k, (a - lat) * 111132, (e - lon) * 111132 * k, (c - lat) * 111132
        t = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(ax + t * (bx - ax), ay + t * (by - ay))

    want = {(p, s) for p, lat, lon in points for s, *ends in segs if near(lat, lon, *ends) <= 149.9}
    assert want <= {tuple(r) for r in got} and len(got) == len({tuple(r) for r in got})
    assert all(near(*next(q[1:] for q in points if q[0] == p), *next(x[1:] for x in segs if x[0] == s)) < 150.1 for p, s in got)


def test_sliding_keeps_nulls_and_ends(spark):
    d = spark.createDataFrame([("a", i, None if i == 4 else i) for i in range(23)] + [("b", 1, 1)], "k string, i int, v int")
    for length, stride, after, drop in ((10, 5, False, False), (10, 5, True, False), (10, 4, False, True), (7, 7, False, False), (5, 1, False, False), (3, 10, False, False)):
        got = {r["start"]: (r["end"], r["window"], r["label_index"]) for r in windows.sliding(d, "k", "i", "v", length, stride, after, drop).where("k = 'a'").collect()}
        last = 23 - length - (1 if after or drop else 0)
        v = [None if i == 4 else i for i in range(23)]
        assert got == {s: (s + length - 1, v[s : s + length], s + length - (0 if after else 1)) for s in range(0, last + 1, stride)}
    assert windows.sliding(d.where(F.lit(False)), "k", "i", "v", 3, 1).count() == 0


def test_sensor_stream_is_appended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = ",".join(readers.IMU)
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text(f"{head}\n" + "".join(f"{100 * k + i},gyro,3,{i}.5,0,0,,,\n" for i in range(50)))
    for _ in range(2):  # the second start goes on from the checkpoint
        q = sinks.append_stream(readers.sensor_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", 1)
        q.processAllAvailable()
        q.stop()
    out = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert out.count() == 150 and out.where("v0 = '49.5'").count() == 3 and tuple(out.columns) == readers.IMU
    assert set(readers.STREAMS) >= {"accel", "gyro", "rv"} and len(readers.STREAMS) == 11


def test_run_slices_keep_to_their_rows(spark):
    import re

    runs = [("c", 0, 3), ("a", 3, 70_000), ("none", 70_003, 0), ("b", 70_003, 1), (None, 70_010, 5)]
    rows = [(k, i) for k, i in enumerate((0, 2, 3, 65_535, 65_536, 70_002, 70_003, 70_003, 70_004, 70_009, 70_014, 70_015, -1, None))]
    out = readers.run_slices(spark.createDataFrame(rows, "id int, i long"), spark.createDataFrame(runs, "run string, start long, length long"), "run", "i")
    want = {0: ("c", 0), 1: ("c", 2), 2: ("a", 0), 3: ("a", 65_532), 4: ("a", 65_533), 5: ("a", 69_999), 6: ("b", 0), 7: ("b", 0), 10: (None, 4)}
    assert {r["id"]: (r["run"], r["place"]) for r in out.collect()} == want and out.columns == ["i", "id", "run", "place"]
    assert not re.search("Join", out._jdf.queryExecution().optimizedPlan().toString())  # runs aren't laid out by index for a join, which could be broadcast
