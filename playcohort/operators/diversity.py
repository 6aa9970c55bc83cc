"""Artist and genre diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playcohort.functions.columns import artist_key, entropy_bits, ratio, xlog2x
from playcohort.operators.rollups import artist_play_counts, artist_rollup


def with_rank_budget(groups: DataFrame, plays: Column, members: Column, top_n: int) -> DataFrame:
    """Add ``top_plays``: what each (userid, play count) group gives to the user's top n.

    Groups are visited from the most played down; one with ``members`` items of equal play
    count fills what is left of the n places. Equal counts are interchangeable in the sum.
    """
    w = (
        Window.partitionBy("userid")
        .orderBy(plays.desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.lit(top_n) - F.coalesce(F.sum(members).over(w), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(members, left))
    return groups.withColumn("top_plays", F.coalesce(plays * taken, F.lit(0)))


def play_count_spectrum(counts: DataFrame) -> DataFrame:
    """(userid, plays): how many artists the user played that often.

    Unlike the artists themselves, a user's distinct play counts are few (fewer than
    sqrt(2N) for N plays), so the ranking window over them stays small for any user.
    """
    return counts.groupBy("userid", "plays").agg(F.count(F.lit(1)).alias("artists"))


def artist_diversity(plays: DataFrame, top_n: int = 20) -> DataFrame:
    """unique_artists, artist_entropy and the play share of the top n artists per user."""
    spectrum = play_count_spectrum(artist_play_counts(plays))
    return (
        with_rank_budget(spectrum, F.col("plays"), F.col("artists"), top_n)
        .groupBy("userid")
        .agg(
            F.sum("artists").alias("unique_artists"),
            entropy_bits(
                F.sum(F.col("plays") * F.col("artists")),
                F.sum(xlog2x(F.col("plays")) * F.col("artists")),
                F.sum("artists"),
            ).alias("artist_entropy"),
            ratio(F.sum("top_plays"), F.sum(F.col("plays") * F.col("artists"))).alias(
                f"artist_concentration_{top_n}"
            ),
        )
    )


def lookup_join(rollup: DataFrame, key: Column, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """Left join of a roll-up with a lookup table.

    Rows without a key match nothing; they are placed by a hash of the whole row, where a
    null key would send all of them to one partition. Whether the lookup is broadcast is left to the size
    estimate; a popular key in a shuffled join is split by adaptive execution.
    """
    own_place = F.concat(F.lit("\x00"), F.xxhash64(*rollup.columns).cast("string"))
    # The key travels once, as the place; beside it only whether it is one.
    keyed = rollup.withColumns({"_keyed": key.isNotNull(), "_place": F.coalesce(key, own_place)})
    side = lookup.withColumnRenamed(lookup_key, "_lookup_key")
    match = (F.col("_place") == F.col("_lookup_key")) & F.col("_keyed")
    return keyed.join(side, match, "left").drop("_keyed", "_place", "_lookup_key")


def genre_join(rollup: DataFrame, artist_genres: DataFrame) -> DataFrame:
    """An artist roll-up with the tag list of each artist, empty where unknown."""
    lookup = artist_genres.select("artist_name_normalized", "genres")
    joined = lookup_join(
        rollup, artist_key(F.col("artist_name")), lookup, "artist_name_normalized"
    )
    empty = F.array().cast("array<string>")
    return joined.withColumn("genres", F.coalesce("genres", empty))


def genre_rollup(artists: DataFrame, artist_genres: DataFrame) -> DataFrame:
    """(userid, genre): tag plays, and in ``row_plays`` the plays themselves, each counted
    once, at the first tag of its artist (a null genre where there is none)."""
    tags = genre_join(artists.select("userid", "artist_name", "plays"), artist_genres).select(
        "userid", "plays", F.posexplode_outer("genres").alias("pos", "genre")
    )
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return tags.groupBy("userid", "genre").agg(
        F.sum(F.when(F.col("pos").isNotNull(), F.col("plays")).otherwise(0)).alias("tag_plays"),
        F.sum(F.when(first, F.col("plays")).otherwise(0)).alias("row_plays"),
    )


def genre_play_counts(plays: DataFrame, artist_genres: DataFrame) -> DataFrame:
    """Plays per (userid, genre); null and empty tags left out."""
    return (
        genre_join(artist_rollup(plays), artist_genres)
        .select("userid", "plays", F.explode("genres").alias("genre"))
        .where(F.col("genre").isNotNull() & (F.col("genre") != ""))
        .groupBy("userid", "genre")
        .agg(F.sum("plays").alias("plays"))
    )


def genre_diversity_from(genres: DataFrame, top_n: int = 5) -> DataFrame:
    """The genre block from ``genre_rollup``; users without any tag keep a row of zeros.

    As with artists, tags of equal play count are merged before a user is ranked.
    """
    real = F.col("genre").isNotNull() & (F.col("genre") != "")
    spectrum = genres.groupBy("userid", F.when(real, F.col("tag_plays")).alias("plays")).agg(
        F.count(F.when(real, 1)).alias("tags"),
        F.sum("tag_plays").alias("tag_plays"),
        F.sum("row_plays").alias("row_plays"),
    )
    counted = F.coalesce(F.col("plays") * F.col("tags"), F.lit(0))
    ranked = with_rank_budget(spectrum, F.col("plays"), F.col("tags"), top_n)
    return ranked.withColumn("counted", counted).groupBy("userid").agg(
        F.sum("tags").alias("unique_genres"),
        entropy_bits(
            F.sum("counted"),
            F.coalesce(F.sum(xlog2x(F.col("plays")) * F.col("tags")), F.lit(0.0)),
            F.sum("tags"),
        ).alias("genre_entropy"),
        ratio(F.sum("top_plays"), F.sum("counted")).alias(f"genre_concentration_{top_n}"),
        ratio(F.sum("tag_plays"), F.sum("row_plays")).alias("avg_genre_tags_per_play"),
    )


def genre_diversity(plays: DataFrame, artist_genres: DataFrame, top_n: int = 5) -> DataFrame:
    return genre_diversity_from(genre_rollup(artist_rollup(plays), artist_genres), top_n)
