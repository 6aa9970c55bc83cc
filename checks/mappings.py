"""The library's input tables, mapped from the test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from playcohort.plans.features import build_feature_matrix
from playcohort.session import configure, on_release, scratch_dir


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def plays_e(spark: SparkSession, sf: str) -> DataFrame:
    """Plays with a time of day."""
    configure(spark)
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("userid"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("").alias("artist_mbid"),
        F.concat(F.lit("artist_"), k).alias("artist_name"),
        F.lit("").alias("track_mbid"),
        F.concat("event_type", F.lit("_"), k).alias("track_name"),
    )


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])


def plays_l(spark: SparkSession, sf: str) -> DataFrame:
    """Plays over several years. A discount of a tenth leaves the track unknown, a tax of
    eight percent without discount the artist."""
    no_track = F.col("l_discount") >= 0.095
    no_artist = (F.col("l_tax") >= 0.075) & (F.col("l_discount") < 0.005)
    # Settled before the join, which then moves neither tax nor discount.
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(~no_artist, F.col("l_suppkey")).alias("artist"),
        F.when(~no_track, F.col("l_partkey")).alias("track"),
    )
    configure(spark)
    return lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("userid"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.lit("").alias("artist_mbid"),
        F.concat(F.lit("S"), "artist").alias("artist_name"),
        F.lit("").alias("track_mbid"),
        F.concat(F.lit("P"), "track").alias("track_name"),
    )


def artist_genres(spark: SparkSession, sf: str) -> DataFrame:
    """Tags by account balance: below 0 the artist is unknown, then no tags, an empty tag,
    a null tag, and from 2500 nation and region."""
    configure(spark)
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    b = F.col("s_acctbal")
    none = F.array().cast("array<string>")
    tags = (
        F.when(b < 1000, none)
        .when(b < 2000, F.array(F.lit(""), F.col("r_name")))
        .when(b < 2500, F.array(F.lit(None).cast("string"), F.col("r_name")))
        .otherwise(F.array("n_name", "r_name"))
    )
    return (
        s.join(n, s["s_nationkey"] == n["n_nationkey"])
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .where(b >= 0)
        .select(
            F.lower(F.concat(F.lit("S"), "s_suppkey")).alias("artist_name_normalized"),
            F.when(b >= 1000, F.col("s_name")).alias("spotify_artist_id"),
            tags.alias("genres"),
            F.when(b >= 1000, F.floor(b / 100).cast("int")).alias("popularity"),
        )
    )


def audio_features(spark: SparkSession, sf: str) -> DataFrame:
    """Audio columns of every (supplier, part) that was sold; small parts have no energy."""
    configure(spark)
    sold = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    part = table(spark, sf, "part")
    pk = F.col("p_partkey")

    def share(factor: int):
        return (pk * factor % 100) / F.lit(97.0)

    return sold.join(part, sold["l_partkey"] == part["p_partkey"]).select(
        F.lower(F.concat(F.lit("S"), "l_suppkey", F.lit("|||P"), "l_partkey")).alias("track_key"),
        F.concat(F.lit("t"), "l_partkey").alias("track_spotify_id"),
        share(7).alias("danceability"),
        F.when(F.col("p_size") > 7, F.col("p_size") / F.lit(47.0)).alias("energy"),
        share(11).alias("valence"),
        ((F.lit(60.0) + pk * 13 % 140) / F.lit(0.97)).alias("tempo"),
        share(17).alias("acousticness"),
        share(19).alias("instrumentalness"),
        share(23).alias("liveness"),
        (F.col("p_retailprice") / F.lit(9700.0)).alias("speechiness"),
        (F.lit(0.0) - F.col("p_size")).alias("loudness"),
        (pk % 2).cast("int").alias("mode"),
        F.lit(4).alias("time_signature"),
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").cast("string").alias("userid"),
        F.when(F.col("c_acctbal") < 9000, F.col("c_mktsegment")).alias("gender"),
        F.col("c_acctbal").alias("age"),
        F.col("n_name").alias("country"),
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Given clusters -1..4 from the balance; customers far in debt have none."""
    configure(spark)
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").where(b >= -500).select(
        F.col("c_custkey").cast("string").alias("userid"),
        (F.floor(F.abs(b)) % 6 - 1).cast("int").alias("cluster"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("cluster"),
    )


_saved: dict[tuple[int, str], str] = {}
on_release(_saved.clear)


def saved_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The feature matrix stage as a written table, built once per session: reports and
    clustering read the stage before them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _saved:
        configure(spark)
        path = f"{scratch_dir(spark)}/user_features"
        build_feature_matrix(
            plays_l(spark, sf),
            artist_genres(spark, sf),
            audio_features(spark, sf),
            profiles(spark, sf),
            save_path=path,
        )
        _saved[key] = path
    return spark.read.parquet(_saved[key])
