"""Queries without SQL: they must cover their whole tables."""

import os

import pytest
from pyspark.sql import functions as F

from wayfold.operators import graph
from wayfold.plans import registry
from wayfold.plans.fixtures import relation

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def test_matcher_sees_every_fix(spark):
    sf = "/root/testdata/sf0.01"
    assert relation(spark, sf, "d_fix").agg(F.max("seq")).first()[0] >= 30
    assert registry.queries()["st_03_matcher"](spark, sf).agg(F.max("t_ns")).first()[0] >= 30


def test_every_segment_is_routed(spark):
    import math

    rows = relation(spark, SF, "d_seg").select("seg_id", "alat", "alon", "blat", "blon").collect()
    tile = lambda r: (math.floor((r["alon"] + 180) / 360 * 2**15), math.floor((1 - math.asinh(math.tan(math.radians(r["alat"]))) / math.pi) / 2 * 2**15))
    at = {r["seg_id"]: tile(r) for r in rows}
    want = {}
    for x, y in set(at.values()):
        block = [tuple(r) for r in rows if abs(at[r["seg_id"]][0] - x) < 2 and abs(at[r["seg_id"]][1] - y) < 2]
        g = graph.RoadGraph(block)
        to = max(r[0] for r in block)
        for s in (s for s, t in at.items() if t == (x, y)):
            metres, path = g.route((s, 10.0), (to, 20.0))
            want[s] = (None if math.isinf(metres) else round(metres, 6), len(path))
    got = registry.queries()["gr_05_07_routes"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {r["req"]: (None if r["metres"] is None else round(r["metres"], 6), r["hops"]) for r in got} == want


def test_components_of_all_roads(spark):
    rows = relation(spark, SF, "d_seg").select("seg_id", "alat", "alon", "blat", "blon").collect()
    q = 0.5 / 111_132.0
    key = lambda a, b: f"{int((a / q + 0.5) // 1)}:{int((b / q + 0.5) // 1)}"
    root: dict[str, str] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        u, v = sorted((find(key(r["alat"], r["alon"])), find(key(r["blat"], r["blon"]))))
        root[v] = u
    least: dict[str, str] = {}
    for n in root:
        least[find(n)] = min(least.get(find(n), n), n)
    got = {r["node"]: r["component"] for r in registry.queries()["gr_06_components"](spark, SF).collect()}
    assert got == {n: least[find(n)] for n in root}


def test_walks_and_distances_on_all_roads(spark):
    seg = {r["seg_id"]: tuple(r) for r in relation(spark, SF, "d_seg").select("seg_id", "alat", "alon", "blat", "blon").collect()}
    g = graph.RoadGraph(seg.values())
    got = registry.queries()["gr_04_road_distances"](spark, SF).collect()
    assert len(got) == len(seg)
    for r in got[::17]:
        want = g.between((r["req"], 20.0), (r["req"] + 5, 30.0), 400.0) if r["req"] + 5 in seg else float("inf")
        assert r["metres"] == (None if want == float("inf") else pytest.approx(want))
    walks = {}
    for r in registry.queries()["gr_03_walks"](spark, SF).collect():
        walks.setdefault(r["req"], []).append((r["rank"], r["seg"], r["direction"]))
    assert set(walks) == set(seg)
    for s in list(seg)[::23]:
        assert [x[1:] for x in sorted(walks[s])] == [(a, w) for a, _, w, _ in g.advance([(s, 10.0, 1, 0.0)], 250.0)]


def test_components_across_cells(spark):
    """A road of many cells that meets itself again far off, one across the equator and the zero meridian, a loop and an end without a place."""
    step = 0.05
    far = [(10.0, 20.0 + step * k) for k in range(200)]
    rows = [(*a, *b) for a, b in zip(far, far[1:])] + [(*far[-1], 10.1, 29.0), (10.1, 29.0, *far[0])]
    rows += [(-0.01, -0.01, 0.01, 0.01), (0.01, 0.01, 40.0, 0.01), (40.0, 0.01, -0.01, -170.0)]
    rows += [(5.0, 5.0, 5.0, 5.0), (6.0, 6.0, None, None)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seg_id long, alat double, alon double, blat double, blon double")
    runs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "")
    out = graph.road_components(d)
    jobs = len(runs.getJobIdsForGroup("components"))
    got = {}
    for r in out.collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(len(n) for n in got.values()) == [1, 1, 4, 201] and all(min(n) == c for c, n in got.items())
    assert jobs <= 20  # rounds don't grow with the length of a road


def test_routes_to_one_goal_share_its_costs():
    import math
    import random

    import numpy as np

    rng, rows = random.Random(5), [(9000, 30.0, 87.0, 30.001, 87.0)]  # one out of reach
    for i, j in ((i, j) for i in range(9) for j in range(9)):
        for di, dj in ((1, 0), (0, 1)):
            if rng.random() < 0.8:
                rows.append((len(rows), 22.3 + 0.001 * i, 87.3 + 0.001 * j, 22.3 + 0.001 * (i + di), 87.3 + 0.001 * (j + dj)))
    g = graph.RoadGraph(rows)
    goal, starts = g.order[len(g.order) // 2], np.arange(len(g.order))
    lengths = np.array([g.length[s] for s in g.order])
    metres, hops = graph.RoutesTo(g, (goal, 20.0), graph.all_turns(g)).routes(starts, np.full(len(starts), 10.0), lengths)
    for k in starts:
        want, path = g.route((g.order[k], 10.0), (goal, 20.0))
        if g.order[k] != goal:
            assert hops[k] == len(path) and (metres[k] == want or math.isclose(metres[k], want, rel_tol=1e-12))
