"""Recent plays that a collector has landed as JSON pages, and their merge with the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from playcohort.schemas import PLAYS, RECENT_PLAYS

DEDUP_KEY = ["userid", "timestamp", "artist_name", "track_name"]


def lookback_filter(plays: DataFrame, as_of: Column, years: int = 5) -> DataFrame:
    """Plays of the last ``365 * years`` days up to ``as_of``, both ends included.

    ``as_of`` should be a literal: the range then reaches the scan as a pushed filter.
    """
    start = as_of - F.make_dt_interval(F.lit(365 * years))
    return plays.where(F.col("timestamp").between(start, as_of))


def min_activity_users(plays: DataFrame, min_scrobbles: int = 50) -> DataFrame:
    """Plays of the users who have at least ``min_scrobbles`` of them."""
    active = (
        plays.groupBy("userid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_scrobbles)
    )
    return plays.join(active, "userid", "left_semi")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed play pages in the layout of the log. Missing ids are '' there, not null."""
    pages = spark.read.schema(RECENT_PLAYS).json(path)
    return pages.select(
        "userid",
        F.timestamp_seconds("uts").alias("timestamp"),
        F.lit("").alias("artist_mbid"),
        F.coalesce("artist", F.lit("")).alias("artist_name"),
        F.lit("").alias("track_mbid"),
        F.col("title").alias("track_name"),
    )


def ingest_recent_plays(
    spark: SparkSession,
    path: str,
    as_of: Column,
    lookback_years: int = 5,
    min_scrobbles: int = 50,
) -> DataFrame:
    """Landed plays inside the look-back window, of users with enough of them there."""
    recent = lookback_filter(read_landed(spark, path), as_of, lookback_years)
    return min_activity_users(recent, min_scrobbles)


def users_to_fetch(universe: DataFrame, landed: DataFrame, min_scrobbles: int = 50) -> DataFrame:
    """Users a collector still has to ask for: those without a saved play table. Users
    below the threshold are never saved and so come up again."""
    saved = (
        landed.groupBy("userid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_scrobbles)
    )
    return universe.join(saved, "userid", "left_anti")


def union_users(frames: Sequence[DataFrame]) -> DataFrame:
    """One play table out of several."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def merge_dedup(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of play tables with one row per (user, time, artist, track), nulls equal.

    The earliest source wins, so its ids survive; inside a source the smallest ids do. The
    rank filter keeps one row per key before the shuffle as well as after it, so many
    copies of one play do not pile up in one task.
    """
    ranked = union_users(
        [s.select(*PLAYS.names).withColumn("src_rank", F.lit(i)) for i, s in enumerate(sources)]
    )
    order = ["src_rank", F.asc_nulls_last("artist_mbid"), F.asc_nulls_last("track_mbid")]
    w = Window.partitionBy(*DEDUP_KEY).orderBy(*order)
    first = ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1)
    return first.select(*PLAYS.names)
