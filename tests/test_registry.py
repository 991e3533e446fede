"""The registry: names, shapes, and a sample of the queries against their SQL."""

import glob
import os

import duckdb
import pytest

from wayfold.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
@pytest.mark.parametrize("name", ["geo_01_haversine", "rot_08_triad", "jn_01_interpolate", "jn_10_srt_01_candidates", "win_09_clock_runs", "win_12_throttle", "agg_14_path_length", "src_13_14_ways", "gr_02_successors", "scl_07_drift_colour", "rot_07_frame_from_up", "geo_06_geodesic", "agg_27_drift_totals", "ml_18_swapped_channels", "ml_03_phone_set", "jn_15_corridors", "win_06_sliding"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(repr, want))
