"""Connected components by alternating stars, as joins and aggregates; no vertex's neighbours meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) with u > v: neighbours are hung under the least one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(least, "u")
    out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v``: for each vertex of ``edges`` (a, b) but the least of its component, that least one."""
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:  # the rounds are about the logarithm of the longest path
        after = scratch.keep(_stars(_stars(now, True), False))
        scratch.drop(now)
        now = after
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen or not sign[0]:
            return now
        seen = sign
