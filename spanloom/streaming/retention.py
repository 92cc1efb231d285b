"""Retention sweep, as a batch query and over a stream of directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_AGE_S = 24 * 3600


def sweep(folders: DataFrame, path: str, modified: str, now: Column, keep: Column) -> DataFrame:
    """Z-01: 'kept' (marked), 'removed' (24 hours or older), or 'young' per folder; no time: 'unknown'."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(modified))
    state = F.when(F.coalesce(keep, F.lit(False)), "kept").when(age.isNull(), "unknown").when(age >= MAX_AGE_S, "removed").otherwise("young")
    return folders.select(F.col(path).alias("path"), age.alias("age_s"), state.alias("state"))


def sweep_stream(listings: DataFrame, path: str, modified: str, seen_at: str, keep: Column, late: str = "1 hour") -> DataFrame:
    """The sweep over a stream of listings: per window of an hour, folders by state.

    An extension: the watermark bounds the state that late listings need.
    """
    judged = listings.withWatermark(seen_at, late).select(seen_at, path, F.when(F.coalesce(keep, F.lit(False)), "kept").when(F.unix_timestamp(seen_at) - F.unix_timestamp(modified) >= MAX_AGE_S, "removed").otherwise("young").alias("state"))
    return judged.groupBy(F.window(seen_at, "1 hour"), "state").agg(F.count("*").alias("n_folders"))
