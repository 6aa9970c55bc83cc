"""All tables of the segment report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from playcohort.operators import profiles as p
from playcohort.operators.importance import feature_importance
from playcohort.session import staged

# Features of the heat map and of the radar chart.
HEATMAP_FEATURES = [
    "artist_entropy", "genre_entropy", "unique_artists", "artist_concentration_20",
    "track_replay_rate", "novelty_ratio", "discovery_velocity_30d", "avg_tracks_per_session",
    "avg_session_length_min", "weekend_ratio", "temporal_hour_entropy", "morning_ratio",
    "evening_ratio", "mean_energy", "mean_valence", "mean_danceability", "mean_acousticness",
]
RADAR_FEATURES = [
    "artist_entropy", "genre_entropy", "novelty_ratio", "track_replay_rate",
    "avg_tracks_per_session", "temporal_hour_entropy",
]


def build_report(
    plays: DataFrame,
    artist_genres: DataFrame,
    matrix: DataFrame,
    labels: DataFrame,
    profiles: DataFrame | None = None,
    coordinates: DataFrame | None = None,
    top_n_genres: int = 12,
    n_trees: int = 200,
) -> dict[str, DataFrame]:
    """Name to table for everything the report shows. ``labels`` is (userid, cluster).

    The summary, one row per cluster and feature, is staged: radar and summary read it.
    """
    summary = staged(p.cluster_summary(matrix, labels))
    labelled = p.cluster_labels(labels, p.cluster_names(matrix, labels), coordinates)
    report = p.segment_report(matrix, labels)
    present = [f for f in RADAR_FEATURES if f in matrix.columns]
    out = {
        "cluster_labels": labelled,
        "cluster_sizes": p.cluster_sizes(labelled, "cluster_name"),
        "cluster_summary": summary,
        "heatmap": p.cluster_zscore_heatmap(matrix, labels, HEATMAP_FEATURES),
        "radar": p.cluster_radar(summary, present),
        "feature_importance": feature_importance(matrix, labels, n_trees),
        "genre_share": p.genre_share_by_cluster(plays, artist_genres, labels, top_n_genres),
        "activity": p.activity_heatmap(plays, labels),
        "segments": report,
        "recommendations": p.segment_recommendations(report),
    }
    if coordinates is not None:
        out["scatter"] = p.scatter_rows(labelled)
    if profiles is not None:
        people = p.demographic_join(labelled, profiles)
        out["gender"] = p.gender_by_cluster(people)
        out["median_age"] = p.median_age_by_cluster(people)
        out["top_countries"] = p.top_countries_per_cluster(people)
    return out
