"""The shared per-user roll-ups every feature block is computed from.

Each is one hash aggregation with map-side combine, so a user who owns a large share of
the plays shrinks before the shuffle. Rows without a user are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playcohort.functions.columns import HOUR_US, floor_div, micros


def slot_width(gap_minutes: float = 30) -> int:
    """Width in microseconds of the time slots used for a session gap.

    The widest divisor of an hour that does not exceed the gap. Two plays in one slot are
    then never further apart than the gap, and a slot never crosses an hour.
    """
    gap = int(gap_minutes * 60_000_000)
    if gap < 1:
        raise ValueError("the session gap must be positive")
    parts = max(1, -(-HOUR_US // gap))
    while HOUR_US % parts:
        parts += 1
    return HOUR_US // parts


def slot_rollup(plays: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """(userid, slot): plays, plays with a track name, first and last instant."""
    us = micros(F.col("timestamp"))
    return (
        plays.where(F.col("userid").isNotNull() & F.col("timestamp").isNotNull())
        .select("userid", us.alias("us"), "track_name")
        .groupBy("userid", floor_div(F.col("us"), slot_width(gap_minutes)).alias("slot"))
        .agg(
            F.count(F.lit(1)).alias("plays"),
            F.count("track_name").alias("tracks"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
        )
    )


def track_rollup(plays: DataFrame) -> DataFrame:
    """(userid, artist_name, track_name): plays and first instant. Null names form groups."""
    return (
        plays.where(F.col("userid").isNotNull())
        .groupBy("userid", "artist_name", "track_name")
        .agg(F.count(F.lit(1)).alias("plays"), F.min(micros(F.col("timestamp"))).alias("first_us"))
    )


def artist_rollup(plays: DataFrame) -> DataFrame:
    """(userid, artist_name): plays and first instant, straight from the plays."""
    return (
        plays.where(F.col("userid").isNotNull())
        .groupBy("userid", "artist_name")
        .agg(F.count(F.lit(1)).alias("plays"), F.min(micros(F.col("timestamp"))).alias("first_us"))
    )


def plain_tracks(plays: DataFrame) -> DataFrame:
    """Every play as a row of a track roll-up that is not added up yet."""
    return plays.select(
        "userid", "artist_name", "track_name", F.lit(1).cast("bigint").alias("plays"),
        micros(F.col("timestamp")).alias("first_us"),
    )


def tracks_by_user(rows: DataFrame, clock: DataFrame) -> DataFrame:
    """The track roll-up of ``rows`` (those of a track roll-up or of several, or of ``plain_tracks``) for
    the users of the clock, with ``now_us``, their last instant.

    One shuffle by user serves the join, this aggregation and those that follow by artist and by
    play count. The join splits a heavy user's rows; they are then combined before a shuffle
    of their own.
    """
    users = clock.select("userid", F.col("last_us").alias("now_us"))
    return (
        rows.join(users.hint("shuffle_hash"), "userid")
        .groupBy("userid", "artist_name", "track_name")
        .agg(F.sum("plays").alias("plays"), F.min("first_us").alias("first_us"), F.max("now_us").alias("now_us"))
    )


#: What ``with_artists`` adds, under the names of ``dated_artists``.
_OF_ARTIST = {"artist_plays": "plays", "artist_first_us": "first_us", "artist_tracks": "distinct_tracks", "artist_now_us": "now_us"}


def with_artists(tracks: DataFrame) -> DataFrame:
    """``tracks_by_user`` with the rows of ``dated_artists`` beside the first track of each artist, so
    that one stored table holds both and lies by user."""
    artist = Window.partitionBy("userid", "artist_name")
    named = F.when(F.col("artist_name").isNotNull(), F.col("track_name"))
    first = F.row_number().over(artist.orderBy("track_name")) == 1
    added = {
        "artist_plays": F.sum("plays").over(artist), "artist_first_us": F.min("first_us").over(artist),
        "artist_tracks": F.count(named).over(artist), "artist_now_us": F.col("now_us"),
    }
    rows = tracks.withColumns({"_first": first, **added})
    return rows.select(
        "userid", "artist_name", "track_name", "plays", "first_us",
        *[F.when(F.col("_first"), F.col(c)).alias(c) for c in added],
    )


def dated_artists(stored: DataFrame) -> DataFrame:
    """The artist roll-up out of ``with_artists``, with the user's last instant."""
    rows = stored.where(F.col("artist_plays").isNotNull())
    return rows.select("userid", "artist_name", *[F.col(c).alias(name) for c, name in _OF_ARTIST.items()])


def artists_from_tracks(tracks: DataFrame, *more: Column) -> DataFrame:
    """The artist roll-up, with distinct named tracks and ``more``, from the track roll-up."""
    return tracks.groupBy("userid", "artist_name").agg(
        F.sum("plays").alias("plays"),
        F.min("first_us").alias("first_us"),
        F.count(F.when(F.col("artist_name").isNotNull(), F.col("track_name"))).alias(
            "distinct_tracks"
        ),
        *more,
    )


def artist_play_counts(plays: DataFrame) -> DataFrame:
    """Plays per (userid, artist_name), null artists left out."""
    return (
        plays.where(F.col("userid").isNotNull() & F.col("artist_name").isNotNull())
        .groupBy("userid", "artist_name")
        .agg(F.count(F.lit(1)).alias("plays"))
    )


def first_seen_artist(plays: DataFrame) -> DataFrame:
    """First play of each (userid, artist_name)."""
    return (
        plays.where(F.col("userid").isNotNull() & F.col("artist_name").isNotNull())
        .groupBy("userid", "artist_name")
        .agg(F.min("timestamp").alias("first_seen"))
    )
