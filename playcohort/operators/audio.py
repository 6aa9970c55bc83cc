"""Audio profile: play-weighted means of track features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playcohort.functions.columns import track_key
from playcohort.operators.diversity import lookup_join
from playcohort.operators.rollups import track_rollup
from playcohort.schemas import AUDIO_COLUMNS


def audio_join(tracks: DataFrame, audio_features: DataFrame) -> DataFrame:
    """A track roll-up next to the audio columns of each track. Lookup rows that miss any
    of the eight values do not take part."""
    lookup = audio_features.dropna(subset=AUDIO_COLUMNS).select("track_key", *AUDIO_COLUMNS)
    key = track_key(F.col("artist_name"), F.col("track_name"))
    return lookup_join(tracks, key, lookup, "track_key")


def audio_profile_from(tracks: DataFrame, audio_features: DataFrame) -> DataFrame:
    """The audio block from the track roll-up; a user without any match keeps nulls."""
    joined = audio_join(tracks.select("userid", "artist_name", "track_name", "plays"), audio_features)
    matched = F.sum(F.when(F.col(AUDIO_COLUMNS[0]).isNotNull(), F.col("plays")))
    return joined.groupBy("userid").agg(
        *[
            F.try_divide(F.sum(F.col("plays") * F.col(c)), matched).alias(f"mean_{c}")
            for c in AUDIO_COLUMNS
        ]
    )


def audio_profile(plays: DataFrame, audio_features: DataFrame) -> DataFrame:
    return audio_profile_from(track_rollup(plays), audio_features)
