"""Summaries of plays and of the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playcohort.functions.columns import numeric_columns, unpivot_numeric
from playcohort.functions.quantiles import exact_quantiles


def dataset_summary(
    plays: DataFrame, artist_genres: DataFrame, audio_features: DataFrame
) -> DataFrame:
    """(metric, value): rows, users, first and last instant (epoch seconds), matched lookups.

    Users are counted with a distinct aggregation that is combined per task first.
    """
    per_user = plays.groupBy("userid").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
    )
    base = per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("scrobbles"),
        F.count("userid").alias("users"),
        F.unix_seconds(F.min("lo")).alias("first_play"),
        F.unix_seconds(F.max("hi")).alias("last_play"),
    ).unpivot([], ["scrobbles", "users", "first_play", "last_play"], "metric", "value")
    artists = artist_genres.agg(
        F.count(F.lit(1)).alias("artists"), F.count("spotify_artist_id").alias("artists_matched")
    ).unpivot([], ["artists", "artists_matched"], "metric", "value")
    tracks = audio_features.agg(F.count(F.lit(1)).alias("tracks")).unpivot(
        [], ["tracks"], "metric", "value"
    )
    return base.unionByName(artists).unionByName(tracks)


def feature_describe(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per feature, quartiles exact."""
    long = unpivot_numeric(matrix.select(*columns), [], columns)
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    # Both sides have one row per column of the matrix.
    return basic.join(F.broadcast(quartiles), "feature", "left")


def feature_histogram(matrix: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] per feature, empty bins included, the last closed.

    A constant feature gets a range of one around its value.
    """
    long = unpivot_numeric(matrix.select(*columns), [], columns).where(F.col("value").isNotNull())
    flat = F.col("lo") == F.col("hi")
    ranges = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ranges = ranges.select(
        "feature",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")).alias("span"),
    )
    place = F.floor((F.col("value") - F.col("lo")) / F.col("span") * bins).cast("int")
    counts = (
        long.join(F.broadcast(ranges), "feature")
        .groupBy("feature", F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(F.broadcast(counts), ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("lo") + F.col("span") * F.col("bin") / bins).alias("bin_lo"),
        (F.col("lo") + F.col("span") * (F.col("bin") + 1) / bins).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, null left out; ties by value."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )
    return counts if n is None else counts.limit(n)


def correlation_features(matrix: DataFrame) -> list[str]:
    return numeric_columns(matrix, exclude=["age"])


def correlation_matrix(matrix: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feat_a, feat_b, correlation): Pearson over the rows where both are known, for every
    ordered pair; null where a feature does not vary.

    Each task turns its batches into six columns x columns tables of sums with matrix
    products; only those small tables are shuffled. Values are shifted by the column
    minimum first, so that constants give exact zeros and little precision is lost.
    """
    names = columns or correlation_features(matrix)
    doubles = [F.col(c).cast("double").alias(c) for c in names]
    data = matrix.select(*doubles)
    low = data.agg(*[F.min(c).alias(c) for c in names]).first()
    shifted = data.select(*[(F.col(c) - F.lit(low[c] or 0.0)).alias(c) for c in names])

    def sums(batches):
        import numpy as np
        import pandas as pd

        d = len(names)
        total = np.zeros((6, d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            m = known.astype(float)
            total += np.stack(
                [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
            )
        a, b = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
        yield pd.DataFrame(
            {"a": a.ravel(), "b": b.ravel()}
            | {k: total[i].ravel() for i, k in enumerate(["n", "sa", "sb", "saa", "sbb", "sab"])}
        )

    parts = ["n", "sa", "sb", "saa", "sbb", "sab"]
    layout = "a int, b int, " + ", ".join(f"{p} double" for p in parts)
    total = shifted.mapInPandas(sums, layout).groupBy("a", "b").agg(*[F.sum(p).alias(p) for p in parts])
    n = F.col("n")

    def spread(s: str, ss: str):
        """n * sum of squares - square of sum; 0 where only rounding is left."""
        v = n * F.col(ss) - F.col(s) * F.col(s)
        return F.when(v > F.lit(1e-12) * n * F.col(ss), v).otherwise(F.lit(0.0))

    cov = n * F.col("sab") - F.col("sa") * F.col("sb")
    r = F.try_divide(cov, F.sqrt(spread("sa", "saa") * spread("sb", "sbb")))
    labels = F.array(*[F.lit(c) for c in names])
    return total.select(
        F.element_at(labels, F.col("a") + 1).alias("feat_a"),
        F.element_at(labels, F.col("b") + 1).alias("feat_b"),
        F.when(r > 1.0, 1.0).when(r < -1.0, -1.0).otherwise(r).alias("correlation"),
        F.col("a").alias("pos_a"),
        F.col("b").alias("pos_b"),
    )


def high_correlation_pairs(correlations: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Unordered pairs with |r| above the threshold, strongest first; ``feat_a`` is the
    later column."""
    r = F.abs("correlation")
    return (
        correlations.where((F.col("pos_a") > F.col("pos_b")) & r.isNotNull() & (r > threshold))
        .select("feat_a", "feat_b", r.alias("correlation"))
        .orderBy(F.desc("correlation"), "feat_a", "feat_b")
    )
