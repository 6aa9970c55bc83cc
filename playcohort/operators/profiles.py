"""Cluster profiles and the tables behind the report.

Labels come as (userid, cluster). Cluster level tables have one row per cluster and feature;
every pass over users ends in a combinable aggregation to that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playcohort.functions.columns import (
    HOUR_US,
    few_groups,
    floor_div,
    micros,
    numeric_columns,
    ratio,
    unpivot_numeric,
)
from playcohort.functions.quantiles import exact_quantiles
from playcohort.operators.diversity import genre_join
from playcohort.operators.topk import head_per_group, rank_genres
from playcohort.schemas import DEMOGRAPHICS
from playcohort.session import staged

# Features a cluster is named after, in order, with the words for a mean well
# above and well below the global one.
NAME_TAGS = [
    ("artist_entropy", "Diverse", "Focused"),
    ("genre_entropy", "Genre-Diverse", "Genre-Focused"),
    ("track_replay_rate", "High-Replay", "Low-Replay"),
    ("novelty_ratio", "Explorer", "Loyalist"),
    ("discovery_velocity_30d", "Fast-Discovery", "Slow-Discovery"),
    ("temporal_hour_entropy", "All-Hours", "Routine-Hours"),
    ("weekend_ratio", "Weekend", "Weekday"),
    ("avg_tracks_per_session", "Long-Sessions", "Short-Sessions"),
]

# Features of the segment report, in order.
REPORT_FEATURES = [
    "artist_entropy", "genre_entropy", "unique_artists", "track_replay_rate", "novelty_ratio",
    "discovery_velocity_30d", "avg_tracks_per_session", "weekend_ratio", "temporal_hour_entropy",
]

# Advice texts.
ADVICE_NEW_ARTISTS = "→ Prioritise new artist recommendations and discovery playlists"
ADVICE_FAVOURITES = "→ Emphasise \"More like your favourites\" and artist radio"
ADVICE_OFFLINE = "→ Offer offline mode / download prompts for favourite tracks"
ADVICE_CROSS_GENRE = "→ Cross-genre mood playlists and genre-blend features work well"
ADVICE_DEEP_GENRE = "→ Deep-dive genre playlists and artist discography features"
ADVICE_WEEKEND = "→ Target weekend push notifications and curated weekend playlists"
ADVICE_LONG_SESSION = "→ Long-session features: auto-queuing, seamless transitions, sleep timer"


def profile_features(matrix: DataFrame, exclude: list[str] | None = None) -> list[str]:
    return numeric_columns(matrix, exclude=[*(exclude or DEMOGRAPHICS), "cluster"])


def _long(matrix: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """(cluster, feature, value) of the labelled users."""
    joined = matrix.select("userid", *features).join(labels.select("userid", "cluster"), "userid")
    return unpivot_numeric(joined, ["cluster"], features)


def cluster_summary(
    matrix: DataFrame, labels: DataFrame, features: list[str] | None = None
) -> DataFrame:
    """(cluster, feature, mean, median, std): sample deviation, exact median, noise included."""
    long = _long(matrix, labels, features or profile_features(matrix))
    few = few_groups(labels, ["cluster"], limit=1_000)
    means = long.groupBy("cluster", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    medians = exact_quantiles(long, ["cluster", "feature"], "value", {"median": 0.5}, few)
    return means.join(medians, ["cluster", "feature"], "left").select(
        "cluster", "feature", "mean", "median", "std"
    )


def cluster_means(matrix: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """(cluster, feature, mean, global_mean, users): the global mean is over all labelled
    users, noise included, and comes from the same pass."""
    sums = _long(matrix, labels, features).groupBy("cluster", "feature").agg(
        F.sum("value").alias("s"), F.count("value").alias("n"), F.count(F.lit(1)).alias("users")
    )
    w = Window.partitionBy("feature")
    return sums.select(
        "cluster",
        "feature",
        F.try_divide("s", F.col("n")).alias("mean"),
        F.try_divide(F.sum("s").over(w), F.sum("n").over(w)).alias("global_mean"),
        "users",
    )


def relative_deviation(mean: Column, global_mean: Column) -> Column:
    return F.try_divide(mean - global_mean, global_mean + F.lit(1e-9))


def cluster_names(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, cluster_name): up to three tags of features that deviate by more than 0.3
    from the global mean, in the fixed order; else the number; -1 is Noise."""
    present = [t for t in NAME_TAGS if t[0] in matrix.columns]
    if not present:
        named = labels.select("cluster").distinct().withColumn("tags", F.array().cast("array<string>"))
    else:
        means = cluster_means(matrix, labels, [t[0] for t in present])
        dev = relative_deviation(F.col("mean"), F.col("global_mean"))
        tag, order = F.lit(None).cast("string"), F.lit(None).cast("int")
        for i, (feature, high, low) in enumerate(present):
            here = F.col("feature") == feature
            tag = F.when(here & (dev > 0.3), high).when(here & (dev < -0.3), low).otherwise(tag)
            order = F.when(here, i).otherwise(order)
        # At most one entry per tag feature.
        entries = F.collect_list(F.when(tag.isNotNull(), F.struct(order.alias("o"), tag.alias("t"))))
        named = means.groupBy("cluster").agg(
            F.slice(F.array_sort(entries), 1, 3).getField("t").alias("tags")
        )
    numbered = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    return named.select(
        "cluster",
        F.when(F.col("cluster") == -1, "Noise")
        .when(F.size("tags") > 0, F.array_join("tags", " / "))
        .otherwise(numbered)
        .alias("cluster_name"),
    )


def cluster_labels(
    labels: DataFrame, names: DataFrame, coordinates: DataFrame | None = None
) -> DataFrame:
    """(userid, cluster, cluster_name[, umap_x, umap_y])."""
    out = labels.select("userid", "cluster").join(names, "cluster", "left").select(
        "userid",
        "cluster",
        F.coalesce("cluster_name", F.col("cluster").cast("string")).alias("cluster_name"),
    )
    if coordinates is None:
        return out
    return out.join(coordinates.select("userid", "umap_x", "umap_y"), "userid", "left")


def scatter_rows(labelled: DataFrame) -> DataFrame:
    """(userid, umap_x, umap_y, cluster_label) for the cluster scatter."""
    fallback = F.when(F.col("cluster") == -1, "Noise").otherwise(
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    )
    return labelled.select(
        "userid", "umap_x", "umap_y", F.coalesce("cluster_name", fallback).alias("cluster_label")
    )


def cluster_zscore_heatmap(
    matrix: DataFrame, labels: DataFrame, features: list[str] | None = None
) -> DataFrame:
    """(cluster, feature, zscore): cluster means standardised across the clusters with the
    population deviation; noise and age left out, 0 where the clusters agree."""
    usable = numeric_columns(matrix, exclude=["age", "cluster"])
    chosen = [f for f in features if f in usable] if features else usable
    means = cluster_means(matrix, labels, chosen).where(F.col("cluster") != -1)
    w = Window.partitionBy("feature")
    flat = F.min("mean").over(w) == F.max("mean").over(w)
    z = F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_pop("mean").over(w))
    return means.select(
        "cluster", "feature", F.when(flat, F.lit(0.0)).otherwise(F.coalesce(z, F.lit(0.0))).alias("zscore")
    )


def cluster_radar(summary: DataFrame, features: list[str]) -> DataFrame:
    """(cluster, feature, value): raw means of the chosen features per cluster, 0 for a
    feature the summary lacks; noise left out."""
    clusters = summary.where(F.col("cluster") != -1).select("cluster").distinct()
    grid = clusters.select("cluster", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    known = summary.select("cluster", "feature", F.col("mean").alias("value"), F.lit(True).alias("_has"))
    return grid.join(known, ["cluster", "feature"], "left").select(
        "cluster", "feature", F.when(F.col("_has"), F.col("value")).otherwise(F.lit(0.0)).alias("value")
    )


def genre_share_by_cluster(
    plays: DataFrame, artist_genres: DataFrame, labels: DataFrame, top_n: int = 10
) -> DataFrame:
    """(cluster, genre, proportion): how the plays of the overall top genres spread inside
    each cluster; missing combinations are 0, noise is left out.

    Plays are scanned once and shrink to (user, artist); both the ranking of the genres and
    the shares derive from that staged roll-up, the latter by (cluster, artist).
    """
    by_user = staged(
        plays.where(F.col("artist_name").isNotNull())
        .groupBy("userid", "artist_name")
        .agg(F.count(F.lit(1)).alias("plays"))
    )
    by_artist = by_user.groupBy("artist_name").agg(F.sum("plays").alias("plays"))
    best_first = Window.orderBy(F.desc("plays"), "genre")  # over top_n rows
    top = staged(
        rank_genres(genre_join(by_artist, artist_genres), top_n).select(
            "genre", F.row_number().over(best_first).alias("place")
        )
    )
    by_cluster = (
        by_user.join(labels.where(F.col("cluster") != -1).select("userid", "cluster"), "userid")
        .groupBy("cluster", "artist_name")
        .agg(F.sum("plays").alias("plays"))
    )
    counts = (
        genre_join(by_cluster, artist_genres)
        .select("cluster", "plays", F.explode("genres").alias("genre"))
        .join(top.select("genre"), "genre", "left_semi")
        .groupBy("cluster", "genre")
        .agg(F.sum("plays").alias("plays"))
    )
    per_cluster = counts.groupBy("cluster").agg(
        F.sum("plays").alias("total"), F.map_from_entries(F.collect_list(F.struct("genre", "plays"))).alias("by_genre")
    )
    # Each cluster lists all of the top genres.
    places = F.explode(F.sequence(F.lit(1), F.lit(top_n)))
    cells = per_cluster.withColumn("place", places).join(top, "place")
    found = F.coalesce(F.try_element_at("by_genre", F.col("genre")), F.lit(0))
    return cells.select("cluster", "genre", ratio(found, F.col("total")).alias("proportion"))


def activity_heatmap(plays: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, dow, hour, plays): all 168 hours of the week for every labelled cluster,
    Monday = 0. Plays are combined per user and hour of the week before the join."""
    hours = floor_div(micros(F.col("timestamp")), HOUR_US)
    # Hour 0 of the epoch is a Thursday midnight.
    week_hour = F.pmod(hours + F.lit(72), F.lit(168)).cast("int")
    by_user = (
        plays.where(F.col("timestamp").isNotNull())
        .groupBy("userid", week_hour.alias("week_hour"))
        .agg(F.count(F.lit(1)).alias("plays"))
    )
    labels = labels.select("userid", "cluster")
    counts = (
        by_user.join(labels, "userid")
        .groupBy("cluster", "week_hour")
        .agg(F.sum("plays").alias("plays"))
    )
    grid = (
        labels.select("cluster")
        .distinct()
        .select("cluster", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("week_hour"))
    )
    return grid.join(counts, ["cluster", "week_hour"], "left").select(
        "cluster",
        F.floor(F.col("week_hour") / 24).cast("int").alias("dow"),
        (F.col("week_hour") % 24).alias("hour"),
        F.coalesce("plays", F.lit(0)).alias("plays"),
    )


def segment_report(
    matrix: DataFrame, labels: DataFrame, features: list[str] | None = None
) -> DataFrame:
    """(cluster, feature, users, percent, mean, global_mean, arrow): one line per segment
    and report feature; the percentage is of all labelled users, noise included."""
    chosen = [f for f in (features or REPORT_FEATURES) if f in matrix.columns]
    means = cluster_means(matrix, labels, chosen)
    w = Window.partitionBy("feature")
    delta = relative_deviation(F.col("mean"), F.col("global_mean"))
    arrow = F.when(delta > 0.15, "▲").when(delta < -0.15, "▼").otherwise("—")
    return (
        means.withColumn("percent", F.col("users") * 100.0 / F.sum("users").over(w))
        .where(F.col("cluster") != -1)
        .select("cluster", "feature", "users", "percent", "mean", "global_mean", arrow.alias("arrow"))
    )


def segment_recommendations(report: DataFrame) -> DataFrame:
    """(cluster, position, recommendation) by five threshold rules on the report lines.
    A missing feature counts as not greater."""

    def mean(feature: str, column: str = "mean") -> Column:
        return F.coalesce(F.max(F.when(F.col("feature") == feature, F.col(column))), F.lit(0.0))

    wide = report.groupBy("cluster").agg(
        mean("novelty_ratio").alias("novelty"),
        mean("novelty_ratio", "global_mean").alias("novelty_all"),
        mean("track_replay_rate").alias("replay"),
        mean("track_replay_rate", "global_mean").alias("replay_all"),
        mean("genre_entropy").alias("genre"),
        mean("genre_entropy", "global_mean").alias("genre_all"),
        mean("weekend_ratio").alias("weekend"),
        mean("avg_tracks_per_session").alias("session"),
        mean("avg_tracks_per_session", "global_mean").alias("session_all"),
    )
    c = F.col
    advice = F.array(
        F.when(c("novelty") > c("novelty_all"), ADVICE_NEW_ARTISTS).otherwise(ADVICE_FAVOURITES),
        F.when(c("replay") > c("replay_all") * 1.2, ADVICE_OFFLINE),
        F.when(c("genre") > c("genre_all"), ADVICE_CROSS_GENRE).otherwise(ADVICE_DEEP_GENRE),
        F.when(c("weekend") > 0.45, ADVICE_WEEKEND),
        F.when(c("session") > c("session_all") * 1.3, ADVICE_LONG_SESSION),
    )
    return wide.select("cluster", F.posexplode(F.array_compact(advice)).alias("pos", "recommendation")).select(
        "cluster", (F.col("pos") + 1).alias("position"), "recommendation"
    )


def demographic_join(labelled: DataFrame, profiles: DataFrame) -> DataFrame:
    return labelled.join(profiles.select("userid", *DEMOGRAPHICS), "userid", "left")


def gender_by_cluster(labelled: DataFrame) -> DataFrame:
    """(cluster_name, gender, proportion) over the users whose gender is known."""
    counts = (
        labelled.where(F.col("gender").isNotNull())
        .groupBy("cluster_name", "gender")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("cluster_name"))
    return counts.select("cluster_name", "gender", ratio(F.col("n"), total).alias("proportion"))


def median_age_by_cluster(labelled: DataFrame) -> DataFrame:
    """(cluster_name, median_age); null where no age is known."""
    # Read four times; the names come from the whole matrix.
    labelled = staged(labelled.select("cluster_name", "age"))
    few = few_groups(labelled, ["cluster_name"])
    medians = exact_quantiles(labelled, ["cluster_name"], "age", {"median_age": 0.5}, few)
    return labelled.select("cluster_name").distinct().join(medians, "cluster_name", "left")


def top_countries_per_cluster(labelled: DataFrame, n: int = 3) -> DataFrame:
    """(cluster_name, country, n): the most frequent countries of each name; ties by name."""
    counts = (
        labelled.where(F.col("country").isNotNull())
        .groupBy("cluster_name", "country")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return head_per_group(counts, ["cluster_name"], [F.desc("n"), "country"], n).drop("rn")


def cluster_sizes(labels: DataFrame, column: str = "cluster") -> DataFrame:
    return labels.groupBy(column).agg(F.count(F.lit(1)).alias("users"))
