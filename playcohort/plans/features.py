"""From plays to one row of features per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playcohort.functions.columns import entropy_bits, ratio
from playcohort.operators.audio import audio_profile_from
from playcohort.operators.blocks import join_profiles
from playcohort.operators.diversity import genre_diversity_from, genre_rollup
from playcohort.operators.engagement import (
    DISCOVERY_WINDOWS,
    NOVELTY_DAYS,
    artist_stats,
    edge_plays,
    engagement_columns,
)
from playcohort.operators.rollups import dated_artists, plain_tracks, tracks_by_user, with_artists
from playcohort.operators.sessions import listening_clock
from playcohort.operators.temporal import stability_columns, temporal_columns
from playcohort.schemas import AUDIO_COLUMNS
from playcohort.session import staged
from playcohort.sources.parquet import write_parquet


def build_feature_matrix(
    plays: DataFrame,
    artist_genres: DataFrame,
    audio_features: DataFrame,
    profiles: DataFrame | None = None,
    *,
    top_artists: int = 20,
    top_genres: int = 5,
    session_gap_minutes: float = 30,
    discovery_windows: tuple[int, ...] = DISCOVERY_WINDOWS,
    novelty_days: int = NOVELTY_DAYS,
    pca_components: int = 5,
    with_stability: bool = True,
    save_path: str | None = None,
    rollups: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per user: artist, genre, rhythm, engagement and audio features, and
    demographics if profiles are given. Sorted by user when saved.

    Plays are scanned three times: for the listening clock, for the tracks and, with two
    columns, for the plays at the edge of the novelty window. The clock is staged first; one
    shuffle by user then makes the track and the artist roll-up, staged as one table. Users lie
    together in it, so what derives from it is combined before it is shuffled. Every user has a clock
    row, so the blocks are left-joined to it; each is already partitioned by user. With
    ``rollups`` (slots, and tracks of one or more rows a key, see ``increments``) only the third scan is made.
    """
    slots, rows = rollups or (None, plain_tracks(plays))
    clock = staged(listening_clock(plays, session_gap_minutes, novelty_days, slots), "zstd")
    tracks = staged(with_artists(tracks_by_user(rows, clock)), "zstd")
    artists = dated_artists(tracks)
    stats = artist_stats(artists, top_artists, discovery_windows, novelty_days)
    genres = genre_diversity_from(genre_rollup(artists, artist_genres), top_genres)
    audio = audio_profile_from(tracks, audio_features)
    stability = stability_columns(clock, pca_components) if with_stability else []
    matrix = (
        clock.join(stats, "userid", "left")
        .join(edge_plays(plays, clock, session_gap_minutes), "userid", "left")
        .join(genres, "userid", "left")
        .join(audio, "userid", "left")
        .select(
            "userid",
            F.when(F.col("unique_artists") > 0, F.col("unique_artists")).alias("unique_artists"),
            F.when(
                F.col("unique_artists") > 0,
                entropy_bits(
                    F.col("artist_plays"), F.col("artist_xlogx"), F.col("unique_artists")
                ),
            ).alias("artist_entropy"),
            F.when(
                F.col("unique_artists") > 0, ratio(F.col("top_plays"), F.col("artist_plays"))
            ).alias(f"artist_concentration_{top_artists}"),
            "unique_genres",
            "genre_entropy",
            f"genre_concentration_{top_genres}",
            "avg_genre_tags_per_play",
            *temporal_columns(),
            *stability,
            *engagement_columns(discovery_windows),
            *[f"mean_{c}" for c in AUDIO_COLUMNS],
        )
    )
    if profiles is not None:
        matrix = join_profiles(matrix, profiles)
    if save_path:
        # Ranges are drawn from a first reading, and the joins above are not made twice for it.
        matrix = staged(matrix, "zstd")
        write_parquet(matrix, save_path, by=["userid"])
        return plays.sparkSession.read.parquet(save_path)
    return matrix
