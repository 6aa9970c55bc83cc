"""Top-k lists. Each keeps a strict order, so equal counts always come out the same way.

``row_number() <= n`` is pushed below the shuffle: a task sends at most n rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playcohort.operators.diversity import genre_join
from playcohort.operators.rollups import artist_play_counts

# Days covered by each named period; None is all time.
PERIOD_DAYS = {
    "7day": 7, "1month": 30, "3month": 90, "6month": 180, "12month": 365, "overall": None,
}


def head_per_group(df: DataFrame, groups: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def top_tracks_per_user(plays: DataFrame, n: int = 20) -> DataFrame:
    """The n most played (artist, track) of each user; ties by artist, then track."""
    counts = (
        plays.dropna(subset=["userid", "artist_name", "track_name"])
        .groupBy("userid", "artist_name", "track_name")
        .agg(F.count(F.lit(1)).alias("play_count"))
    )
    order = [F.desc("play_count"), "artist_name", "track_name"]
    return head_per_group(counts, ["userid"], order, n).drop("rn")


def tracks_to_enrich(plays: DataFrame, n: int = 20) -> DataFrame:
    return top_tracks_per_user(plays, n).select("artist_name", "track_name").distinct()


def top_artists_by_period(
    plays: DataFrame, as_of: Column, period: str = "overall", limit: int = 50
) -> DataFrame:
    """(userid, artist_name, playcount): the most played artists up to ``as_of``."""
    if period not in PERIOD_DAYS:
        raise ValueError(f"unknown period {period!r}; one of {', '.join(PERIOD_DAYS)}")
    days = PERIOD_DAYS[period]
    inside = F.col("timestamp") <= as_of
    if days is not None:
        inside = inside & (F.col("timestamp") >= as_of - F.make_dt_interval(F.lit(days)))
    counts = artist_play_counts(plays.where(inside)).withColumnRenamed("plays", "playcount")
    order = [F.desc("playcount"), "artist_name"]
    return head_per_group(counts, ["userid"], order, limit).drop("rn")


def artist_key_plays(plays: DataFrame) -> DataFrame:
    """Plays per artist over all users, in the shape the genre join takes."""
    return (
        plays.where(F.col("artist_name").isNotNull())
        .groupBy("artist_name")
        .agg(F.count(F.lit(1)).alias("plays"))
    )


def top_genres(plays: DataFrame, artist_genres: DataFrame, n: int = 10) -> DataFrame:
    """The n most played genres over all plays; ties by name."""
    return rank_genres(genre_join(artist_key_plays(plays), artist_genres), n)


def rank_genres(tagged: DataFrame, n: int) -> DataFrame:
    """The n genres with the most plays among rows of plays and genre tags."""
    return (
        tagged.select("plays", F.explode("genres").alias("genre"))
        .where(F.col("genre").isNotNull() & (F.col("genre") != ""))
        .groupBy("genre")
        .agg(F.sum("plays").alias("plays"))
        .orderBy(F.desc("plays"), "genre")
        .limit(n)
    )
