"""Writers of tracks, road files and manifests; the row-wise parts are DataFrames of formatted columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed(x: str, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.col(x).cast("double"))


def long_sensors(ticks: DataFrame, keys: list[str], vectors: dict[str, tuple[str, str, str]], places: dict[str, int] | None = None) -> DataFrame:
    """One row for each tick and sensor from ticks with the vectors side by side."""
    parts = [F.struct(F.lit(s).alias("sensor"), *(fixed(c, (places or {}).get(s, 6)).alias(f"v{i}") for i, c in enumerate(v))) for s, v in vectors.items()]
    return ticks.select(*keys, F.explode(F.array(*parts)).alias("s")).select(*keys, "s.*")


def numbered_track(track: DataFrame, key: str, order: str) -> DataFrame:
    """``index, lat, lon`` from zero within each series."""
    return track.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long").alias("index"), "lat", "lon")


def road_rows(segments: DataFrame) -> DataFrame:
    """Endpoints to seven decimals: ends that meet must be written alike."""
    return segments.select(*(fixed(c, 7).alias(c) for c in ("alat", "alon", "blat", "blon")), "cls")


def manifest(candidates: DataFrame, reason: Column) -> DataFrame:
    """Every candidate, accepted or not, with the reason why not."""
    return candidates.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def bundle_offsets(runs: DataFrame, key: str) -> DataFrame:
    """``key, length, start``: runs laid one after the other in the order of their names."""
    n = runs.groupBy(key).agg(F.count("*").alias("length"))
    return n.withColumn("start", F.sum("length").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def append_stream(stream: DataFrame, path: str, checkpoint: str, seconds: int = 2):
    """Appends a stream as CSV, a file for each trigger; restarts go on from the checkpoint."""
    return stream.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").outputMode("append").start()


def session_metadata(sessions: DataFrame) -> DataFrame:
    """``session_id, json``: the metadata of each session, with its summary once there is one (``duration_s, imu_samples, gps_fixes``)."""
    summary = F.when(F.col("duration_s").isNotNull(), F.struct("duration_s", "imu_samples", "gps_fixes"))
    return sessions.select("session_id", F.to_json(F.struct("session_id", "app_version", F.lit("elapsedRealtimeNanos").alias("timebase"), summary.alias("summary"))).alias("json"))


def rewrite(df: DataFrame, path: str) -> None:
    """Writes a small table over what is there; its rows must not come from there."""
    df.coalesce(1).write.mode("overwrite").json(path)


def tensor_set(windows: DataFrame, path: str, **meta) -> None:
    """Windows with their targets as Parquet arrays, and the set's facts as JSON beside them."""
    import json

    windows.write.mode("overwrite").parquet(f"{path}/windows")
    spark = windows.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def training_results(results: DataFrame, mean: list[float], sd: list[float]) -> DataFrame:
    """``variant, json``: one record for each variant, with the normalisation that it was trained with."""
    rest = [c for c in results.columns if c != "variant"]
    norm = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    return results.select("variant", F.to_json(F.struct("variant", *rest, norm(mean).alias("norm_mean"), norm(sd).alias("norm_sd"))).alias("json"))
