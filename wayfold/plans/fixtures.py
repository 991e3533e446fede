"""Relations derived from the supplied tables, as one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq0 FROM {events}"
_SEQ = f"(SELECT user_id AS session, event_id, CAST(seq0 AS BIGINT) AS seq FROM ({_BASE}) b0)"
SQL = {
    "d_fix": f"""SELECT session, event_id, seq, CAST(seq + 5 * ((seq - seq % 40) / 40) AS DOUBLE) AS t_s,
  CAST(22.3 AS DOUBLE) + CAST(0.0002 AS DOUBLE) * seq + CAST(0.00001 AS DOUBLE) * (event_id % 7) AS lat,
  CAST(87.3 AS DOUBLE) + CAST(0.00015 AS DOUBLE) * seq + CAST(0.00001 AS DOUBLE) * (event_id % 11) AS lon,
  CAST((event_id * 13) % 40 + 3 AS DOUBLE) AS acc, CAST((event_id * 37) % 360 AS DOUBLE) AS bearing,
  CAST((event_id * 7) % 150 AS DOUBLE) / 10 AS speed, event_id % 9 AS used FROM {_SEQ} b1""",
    "d_imu": f"""SELECT session, seq, 'accel' AS sensor, seq * 100000000 AS t_ns, CAST((event_id * 3) % 41 - 20 AS DOUBLE) / 10 AS v0,
  CAST((event_id * 5) % 37 - 18 AS DOUBLE) / 100 AS v1, CAST(9.80665 AS DOUBLE) + CAST((event_id * 7) % 31 - 15 AS DOUBLE) / 100 AS v2, CAST(NULL AS DOUBLE) AS v3 FROM {_SEQ} a1
  UNION ALL SELECT session, seq, 'gyro', seq * 100000000 + 30000000, CAST((event_id * 11) % 21 - 10 AS DOUBLE) / 1000,
  CAST((event_id * 13) % 21 - 10 AS DOUBLE) / 1000, CAST((event_id * 17) % 61 - 30 AS DOUBLE) / 1000, CAST(NULL AS DOUBLE) FROM {_SEQ} a2
  UNION ALL SELECT session, seq, 'rv', seq * 100000000 + 50000000, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), sin(radians(CAST((event_id * 2) % 360 AS DOUBLE)) / 2), cos(radians(CAST((event_id * 2) % 360 AS DOUBLE)) / 2) FROM {_SEQ} a3""",
    "d_quat": """SELECT vec_id, x / n AS x, y / n AS y, z / n AS z, w / n AS w, label FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM
  (SELECT vec_id, label, CAST(element_at(embedding, 1) AS DOUBLE) AS x, CAST(element_at(embedding, 2) AS DOUBLE) AS y, CAST(element_at(embedding, 3) AS DOUBLE) AS z, CAST(element_at(embedding, 4) AS DOUBLE) AS w FROM {embeddings}) q0) q1""",
    "d_seg": """SELECT seg_id, alat, alon, alat + (CASE WHEN side = 1 THEN CAST(0.001 AS DOUBLE) ELSE 0 END) AS blat, alon + (CASE WHEN side = 0 THEN CAST(0.001 AS DOUBLE) ELSE 0 END) AS blon, cls, oneway FROM
  (SELECT 2 * p_partkey + side AS seg_id, side, CAST(22.3 AS DOUBLE) + CAST(0.001 AS DOUBLE) * ((p_partkey - p_partkey % 40) / 40) AS alat, CAST(87.3 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (p_partkey % 40) AS alon,
  CASE p_size % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' ELSE 'footway' END AS cls, p_partkey % 5 = 0 AS oneway FROM {part}, (SELECT 0 AS side UNION ALL SELECT 1 AS side) s0) s1""",
    "d_pred": """SELECT l_suppkey AS run, l_orderkey * 10 + l_linenumber AS i, l_quantity AS truth, l_quantity * (CAST(0.8 AS DOUBLE) + l_discount) + 10 * l_tax AS pred FROM {lineitem}""",
}
_D = "CAST({} AS DOUBLE)".format
#: Matches, integrator samples and channels made of the fixes.
SQL |= {
    "d_match": f"""SELECT session, seq, t_s, speed, lat AS dr_lat, lon AS dr_lon, lat + {_D(0.00008)} * (event_id % 5 - 2) + CASE WHEN event_id % 17 = 0 THEN {_D(0.0004)} ELSE 0 END AS snap_lat,
  lon + {_D(0.00006)} * (event_id % 7 - 3) AS snap_lon, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, lat + {_D(0.0000217)} * (event_id % 9 - 4) + {_D(0.0000031)} AS lat, lon + {_D(0.0000293)} * (event_id % 4) AS lon, event_id % 3 <> 0 AS matched FROM ({SQL["d_fix"]}) m0""",
    "d_dr": f"""SELECT session, seq, t_s, event_id % 13 <> 0 AS accepted, event_id % 6 = 0 AS still, speed * {_D(0.8)} + CAST((event_id * 3) % 10 AS DOUBLE) / 20 AS speed, speed AS truth,
  speed * {_D(0.7)} AS step_m, speed AS true_m FROM ({SQL["d_fix"]}) m0""",
    "d_chan": f"""SELECT session, seq, t_s, lat, lon, bearing, speed, speed * {_D(0.85)} + CAST((event_id * 3) % 11 AS DOUBLE) / 10 AS model_speed, CAST(event_id % 21 - 10 AS DOUBLE) / 100 AS yaw,
  CAST(event_id % 21 - 10 AS DOUBLE) / 90 + CAST(event_id % 5 AS DOUBLE) / 1000 AS model_yaw, CAST(event_id % 21 - 10 AS DOUBLE) / 95 AS gyro_yaw, CASE WHEN session % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM ({SQL["d_fix"]}) m0""",
}
TABLES = ("events", "embeddings", "part", "lineitem")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needed = [t for t in TABLES if f"{{{t}}}" in SQL[name]]
    return spark.sql(SQL[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needed})


def oracle(name: str) -> str:
    """The relation for DuckDB."""
    return SQL[name].format(**{t: t for t in TABLES}).replace("element_at(embedding, ", "list_extract(embedding, ")
