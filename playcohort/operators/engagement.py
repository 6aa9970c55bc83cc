"""Engagement and discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from playcohort.functions.columns import DAY_US, floor_div, micros, ratio
from playcohort.operators.diversity import with_rank_budget
from playcohort.operators.rollups import (
    artist_rollup,
    artists_from_tracks,
    plain_tracks,
    slot_width,
    track_rollup,
    tracks_by_user,
)
from playcohort.operators.sessions import listening_clock
from playcohort.session import staged

DISCOVERY_WINDOWS = (30, 90)
NOVELTY_DAYS = 90
#: Edge slots, one per user at most, that are broadcast: three narrow columns, some 20 MB.
EDGES_SENT = 250_000


def edge_plays(plays: DataFrame, clock: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Per user the plays of their edge slot that fall at or after their cutoff.

    ``clock`` is read twice and should be staged. Edge slots are counted first: without any
    the plays are not read at all; up to ``EDGES_SENT`` of them are sent to the plays, which
    are then reduced where they lie; more are joined on (userid, slot), so a heavy user's
    plays are spread over their slots.
    """
    events = plays.where(F.col("userid").isNotNull()).select(
        "userid", micros(F.col("timestamp")).alias("us")
    )
    events = events.withColumn("slot", floor_div(F.col("us"), slot_width(gap_minutes)))
    edges = clock.where(F.col("edge_slot").isNotNull()).select(
        "userid", F.col("edge_slot").alias("slot"), "cutoff_us"
    )
    n = edges.count()
    if n == 0:
        return edges.select("userid", F.lit(0).cast("bigint").alias("recent_edge"))
    if n <= EDGES_SENT:
        edges = F.broadcast(edges)
    return (
        events.join(edges, ["userid", "slot"])
        .where(F.col("us") >= F.col("cutoff_us"))
        .groupBy("userid")
        .agg(F.count(F.lit(1)).alias("recent_edge"))
    )


def _within(days: int) -> Column:
    return F.col("first_us") >= F.col("now_us") - F.lit(days * DAY_US)


def artist_stats(
    dated: DataFrame,
    top_n: int = 20,
    windows: Sequence[int] = DISCOVERY_WINDOWS,
    novelty_days: int = NOVELTY_DAYS,
) -> DataFrame:
    """Per user everything that derives from their artists (an artist roll-up with ``now_us``, the
    user's own last play): counts, entropy sums, the top n and first plays inside the
    windows that end at the last play.

    An artist is new in a window exactly when its first play lies in the window, so the
    roll-up is read once and never joined to itself. A missing artist name has plays but is
    no artist: it enters the novelty count only.
    """
    named = F.col("artist_name").isNotNull()
    spectrum = dated.groupBy("userid", F.when(named, F.col("plays")).alias("plays")).agg(
        F.count("artist_name").alias("artists"),
        F.sum("distinct_tracks").alias("distinct_tracks"),
        F.sum(F.when(_within(novelty_days), dated["plays"]).otherwise(0)).alias("novel_plays"),
        *[F.count(F.when(named & _within(d), 1)).alias(f"new_{d}") for d in windows],
    )
    return (
        with_rank_budget(spectrum, F.col("plays"), F.col("artists"), top_n)
        .withColumn("artist_plays", F.coalesce(F.col("plays") * F.col("artists"), F.lit(0)))
        .withColumn(
            "xlogx", F.coalesce(F.col("artist_plays") * F.log2("plays"), F.lit(0.0))
        )
        .groupBy("userid")
        .agg(
            F.sum("artists").alias("unique_artists"),
            F.sum("artist_plays").alias("artist_plays"),
            F.sum("xlogx").alias("artist_xlogx"),
            F.sum("top_plays").alias("top_plays"),
            F.coalesce(F.max("plays"), F.lit(0)).alias("top_artist_plays"),
            F.sum("distinct_tracks").alias("unique_tracks"),
            F.sum("novel_plays").alias("novel_plays"),
            *[F.sum(f"new_{d}").alias(f"new_{d}") for d in windows],
        )
    )


def engagement_columns(windows: Sequence[int] = DISCOVERY_WINDOWS) -> list[Column]:
    """The engagement features over clock, ``artist_stats`` and ``edge_plays`` columns."""
    recent = F.col("recent_full") + F.coalesce(F.col("recent_edge"), F.lit(0))
    return [
        F.col("plays").alias("total_scrobbles"),
        F.col("unique_tracks"),
        ratio(F.col("plays"), F.col("unique_tracks")).alias("track_replay_rate"),
        ratio(F.col("tracks"), F.col("sessions")).alias("avg_tracks_per_session"),
        F.col("sessions").alias("session_count"),
        ratio(F.col("session_us") / 60_000_000.0, F.col("sessions")).alias(
            "avg_session_length_min"
        ),
        *[(F.col(f"new_{d}") / F.lit(float(d))).alias(f"discovery_velocity_{d}d") for d in windows],
        ratio(F.col("novel_plays"), recent).alias("novelty_ratio"),
        ratio(F.col("top_artist_plays"), F.col("plays")).alias("top_artist_play_share"),
    ]


def engagement_features(
    plays: DataFrame,
    session_gap_minutes: float = 30,
    windows: Sequence[int] = DISCOVERY_WINDOWS,
    novelty_days: int = NOVELTY_DAYS,
) -> DataFrame:
    """The engagement block. The clock, one row per user, is staged: three steps read it. All that
    derives from artists is made on one shuffle of the plays by user."""
    clock = staged(listening_clock(plays, session_gap_minutes, novelty_days))
    tracks = tracks_by_user(plain_tracks(plays), clock)
    artists = artists_from_tracks(tracks, F.max("now_us").alias("now_us"))
    stats = artist_stats(artists, windows=windows, novelty_days=novelty_days)
    return (
        clock.join(stats, "userid", "left")
        .join(edge_plays(plays, clock, session_gap_minutes), "userid", "left")
        .select("userid", *engagement_columns(windows))
    )


def total_scrobbles(plays: DataFrame) -> DataFrame:
    return (
        plays.where(F.col("userid").isNotNull())
        .groupBy("userid")
        .agg(F.count(F.lit(1)).alias("total_scrobbles"))
    )


def track_stats(plays: DataFrame) -> DataFrame:
    """unique_tracks, track_replay_rate and top_artist_play_share without the session pass."""
    return (
        artists_from_tracks(track_rollup(plays))
        .groupBy("userid")
        .agg(
            F.sum("distinct_tracks").alias("unique_tracks"),
            ratio(F.sum("plays"), F.sum("distinct_tracks")).alias("track_replay_rate"),
            ratio(
                F.max(F.when(F.col("artist_name").isNotNull(), F.col("plays")).otherwise(0)),
                F.sum("plays"),
            ).alias("top_artist_play_share"),
        )
    )


def _dated_artists(plays: DataFrame) -> DataFrame:
    """The artist roll-up next to each user's last instant; only roll-up rows are joined."""
    artists = artist_rollup(plays)
    now = (
        plays.where(F.col("userid").isNotNull())
        .groupBy("userid")
        .agg(F.max(micros(F.col("timestamp"))).alias("now_us"))
    )
    return artists.join(now, "userid")


def discovery_velocity(plays: DataFrame, windows: Sequence[int] = DISCOVERY_WINDOWS) -> DataFrame:
    """New artists per day in each window ending at the user's own last play."""
    named = F.col("artist_name").isNotNull()
    return (
        _dated_artists(plays)
        .groupBy("userid")
        .agg(
            *[
                (F.count(F.when(named & _within(d), 1)) / F.lit(float(d))).alias(
                    f"discovery_velocity_{d}d"
                )
                for d in windows
            ]
        )
    )


def new_artists(plays: DataFrame, days: int) -> DataFrame:
    """(userid, artist_name) pairs first played in the user's last ``days`` days."""
    return (
        _dated_artists(plays)
        .where(F.col("artist_name").isNotNull() & _within(days))
        .select("userid", "artist_name")
    )
