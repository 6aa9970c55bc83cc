"""One query per operator of the inventory, on the mapped test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from types import SimpleNamespace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from checks import mappings as m
from playcohort.functions import columns as C
from playcohort.operators import audio, blocks, cluster, density, diversity, engagement, explore
from playcohort.operators import hierarchy, importance, prep, profiles as prof, quality, rollups, sessions
from playcohort.operators import temporal, topk
from playcohort.operators.pairwise import point_arrays
from playcohort.plans import clustering as plan_clustering, increments
from playcohort.plans.enrichment import ARTIST_ANSWER, run_enrichment
from playcohort.plans.features import build_feature_matrix
from playcohort.schemas import ARTIST_GENRES, DEMOGRAPHICS
from playcohort.session import configure, on_release, scratch_dir, staged
from playcohort.sources import ingest, lookup, parquet, tsv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STABILITY = [f"temporal_stability_pc{i}" for i in range(1, 6)]
GAP_6H = 360
AS_OF = "2000-06-01 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def r6(df: DataFrame) -> DataFrame:
    """Doubles at six places, counts as bigint."""

    def show(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(c.cast("double"), 6).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        return c

    return df.select(*[show(f) for f in df.schema.fields])


def with_us(df: DataFrame, column: str = "timestamp", name: str = "ts_us") -> DataFrame:
    """Instants as epoch microseconds, comparable in any client."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, C.micros(F.col(column)).alias(name))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# -- sources, sinks, ingestion ---------------------------------------------------------


def raw_play_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A play log with every kind of irregular line, by line number: short, too long, bad
    time, artist empty or blank, missing track, stray quote."""
    ts = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    user, artist = F.col("o_custkey").cast("string"), F.concat(F.lit("S"), "l_suppkey")
    track, mbid = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("m"), "l_suppkey")
    n = F.col("l_linenumber")

    def line(*fields: Column) -> Column:
        return F.concat_ws("\t", *fields)

    lit = F.lit
    text = (
        F.when(n == 1, line(F.concat(lit(" "), user, lit(" ")), ts, mbid, artist, lit(""), track))
        .when(n == 2, line(user, ts, mbid, artist))
        .when(n == 3, line(user, ts, mbid, artist, lit(""), track, lit("extra")))
        .when(n == 4, line(user, lit("not a time"), mbid, artist, lit(""), track))
        .when(n == 5, line(user, ts, mbid, lit(""), lit(""), track))
        .when(n == 6, line(user, ts, mbid, lit("   "), lit(""), track))
        .otherwise(line(user, ts, mbid, F.concat(lit('"'), artist), lit(""), lit("None")))
    )
    return m.order_lines(spark, sf).select(text.alias("value"))


@query
def q_read_plays_tsv(spark, sf):
    path = f"{scratch_dir(spark)}/plays.tsv"
    raw_play_lines(spark, sf).write.text(path)
    return with_us(tsv.read_plays_tsv(spark, path))


@query
def q_read_profiles_tsv(spark, sf):
    configure(spark)
    b = F.col("c_acctbal")
    day = F.date_add(F.lit("2005-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int"))
    signup = (
        F.when(b < 3000, F.date_format(day, "MMM d, yyyy"))
        .when(b < 6000, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.lit("some day"))
    )
    age = F.when(b < 0, F.lit("unknown")).otherwise(b.cast("string"))
    fields = F.concat_ws(
        "\t", F.concat(F.lit(" "), F.col("c_custkey").cast("string")), "c_mktsegment", age,
        F.lit("NA"), signup,
    )
    # Some records are followed by a blank line, which is no record.
    text = F.when(b > 9000, F.concat(fields, F.lit("\n"))).otherwise(fields)
    path = f"{scratch_dir(spark)}/profiles.tsv"
    m.table(spark, sf, "customer").select(text.alias("value")).write.text(path)
    return r6(with_us(tsv.read_profiles_tsv(spark, path), "signup", "signup_us"))


@query
def q_read_parquet(spark, sf):
    configure(spark)
    df = parquet.read_parquet(spark, f"{sf}/orders.parquet")
    return r6(with_us(df, "o_orderdate", "order_us"))


@query
def q_write_parquet(spark, sf):
    plays = m.plays_e(spark, sf)
    path = f"{scratch_dir(spark)}/plays"
    parquet.write_parquet(plays, path, by=["userid"], sort_within=["timestamp"])
    return with_us(spark.read.parquet(path))


@query
def q_user_sample(spark, sf):
    return with_us(parquet.sample_users(m.plays_l(spark, sf), n_users=50, seed=42))


@query
def q_user_universe(spark, sf):
    return parquet.user_universe(m.profiles(spark, sf), m.plays_l(spark, sf))


def landed_pages(spark, sf) -> str:
    """Recent plays as a collector would land them; unknown artists have no name field."""
    plays = m.plays_l(spark, sf)
    path = f"{scratch_dir(spark)}/pages"
    plays.select(
        "userid",
        F.unix_seconds("timestamp").alias("uts"),
        F.col("artist_name").alias("artist"),
        F.col("track_name").alias("title"),
    ).write.json(path)
    return path


@query
def q_ingest_recent_plays(spark, sf):
    path = landed_pages(spark, sf)
    return with_us(ingest.ingest_recent_plays(spark, path, as_of(), 2, 10))


@query
def q_ingest_resume(spark, sf):
    universe = parquet.user_universe(m.profiles(spark, sf))
    return ingest.users_to_fetch(universe, m.plays_l(spark, sf), 40)


@query
def q_clean_plays(spark, sf):
    raw = m.plays_l(spark, sf)
    blank = F.when(F.col("track_name").isNull(), F.lit(" \t ")).otherwise(
        F.concat(F.lit("  "), F.col("artist_name"), F.lit(" "))
    )
    named = F.when(F.col("artist_name").isNotNull(), blank)
    return with_us(tsv.clean_plays(raw.withColumn("artist_name", named)))


@query
def q_lookback_filter(spark, sf):
    return with_us(ingest.lookback_filter(m.plays_l(spark, sf), as_of(), 2))


@query
def q_min_activity_users(spark, sf):
    return with_us(ingest.min_activity_users(m.plays_l(spark, sf), 40))


@query
def q_normalize_artist_key(spark, sf):
    configure(spark)
    messy = F.concat(F.lit("\t "), F.upper("s_name"), F.lit("  "))
    return m.table(spark, sf, "supplier").select("s_suppkey", C.artist_key(messy).alias("artist_key"))


@query
def q_track_key(spark, sf):
    key = C.track_key(F.col("artist_name"), F.col("track_name"))
    return (
        m.plays_l(spark, sf)
        .groupBy(key.alias("track_key"))
        .agg(F.count(F.lit(1)).alias("plays"))
    )


@query
def q_select_features(spark, sf):
    matrix = blocks.join_profiles(diversity.artist_diversity(m.plays_l(spark, sf)), m.profiles(spark, sf))
    return r6(matrix.select("userid", *prep.select_features(matrix)))


@query
def q_drop_noise(spark, sf):
    return r6(quality.drop_noise(m.labels(spark, sf)))


# -- joins -----------------------------------------------------------------------------


@query
def q_genre_join(spark, sf):
    joined = diversity.genre_join(rollups.artist_rollup(m.plays_l(spark, sf)), m.artist_genres(spark, sf))
    return joined.select(
        "userid", "artist_name", "plays", F.size("genres").cast("bigint").alias("tags"),
        F.array_join("genres", "/", "?").alias("genres"),
    )


@query
def q_audio_join(spark, sf):
    joined = audio.audio_join(rollups.track_rollup(m.plays_l(spark, sf)), m.audio_features(spark, sf))
    return r6(joined.select("userid", "artist_name", "track_name", "plays", "danceability", "energy", "tempo"))


@query
def q_feature_block_outer_join(spark, sf):
    plays = staged(m.plays_l(spark, sf), "zstd")  # five blocks read it
    return r6(
        blocks.join_feature_blocks(
            [
                diversity.artist_diversity(plays),
                diversity.genre_diversity(plays, m.artist_genres(spark, sf)),
                temporal.temporal_features(m.plays_e(spark, sf)),
                engagement.engagement_features(plays),
                audio.audio_profile(plays, m.audio_features(spark, sf)),
            ]
        ).drop(*STABILITY)
    )


@query
def q_profile_left_join(spark, sf):
    block = engagement.total_scrobbles(m.plays_l(spark, sf))
    return r6(blocks.join_profiles(block, m.profiles(spark, sf)))


@query
def q_semi_join_users(spark, sf):
    rich = m.profiles(spark, sf).where(F.col("age") > 5000)
    return with_us(blocks.keep_users(m.plays_l(spark, sf), rich))


@query
def q_anti_join_known_artists(spark, sf):
    return engagement.new_artists(m.plays_l(spark, sf), 90)


@query
def q_cluster_label_join(spark, sf):
    return r6(with_us(blocks.join_cluster_labels(m.plays_l(spark, sf), m.labels(spark, sf))))


def labelled(spark, sf) -> DataFrame:
    names = prof.cluster_names(m.saved_matrix(spark, sf), m.labels(spark, sf))
    return prof.cluster_labels(m.labels(spark, sf), names)


@query
def q_demographic_join(spark, sf):
    return r6(prof.demographic_join(m.labels(spark, sf), m.profiles(spark, sf)))


@query
def q_lookup_missing_keys(spark, sf):
    return lookup.missing_artists(m.plays_l(spark, sf), m.artist_genres(spark, sf))


@query
def q_lookup_upsert(spark, sf):
    """Known artists, plus an answer for every missing one and a new one for untagged ones."""
    cache = m.artist_genres(spark, sf)
    missing = lookup.missing_artists(m.plays_l(spark, sf), cache).select(
        "artist_key",
        F.lit(None).cast("string").alias("spotify_artist_id"),
        F.lit(None).cast("array<string>").alias("genres"),
        F.lit(None).cast("int").alias("popularity"),
    )
    renewed = cache.where(F.size("genres") == 0).select(
        F.col("artist_name_normalized").alias("artist_key"),
        F.concat(F.lit("new_"), "artist_name_normalized").alias("spotify_artist_id"),
        F.array(F.lit("fresh")).alias("genres"),
        F.lit(50).alias("popularity"),
    )
    new = lookup.artist_answers(missing.unionByName(renewed))
    out = lookup.upsert(cache, new, "artist_name_normalized")
    return r6(out.withColumn("genres", F.array_join("genres", "/", "?")))


@query
def q_lookup_missing_tracks(spark, sf):
    """Tracks that the lookup lacks: those of short parts, and spellings that share a key."""
    plays = m.plays_l(spark, sf)
    odd = plays.withColumn("track_name", F.lower("track_name"))
    return lookup.missing_tracks(plays.unionByName(odd), _known_tracks(spark, sf))


def _known_tracks(spark, sf) -> DataFrame:
    return m.audio_features(spark, sf).where(F.col("energy").isNotNull())


@query
def q_lookup_upsert_tracks(spark, sf):
    """Answers for the missing tracks: by the last digit of the part resolved with features,
    resolved without, or not resolved and so not kept."""
    known = _known_tracks(spark, sf).select("track_key", "energy")
    missing = lookup.missing_tracks(m.plays_l(spark, sf), known)
    digit = F.right("track_name", F.lit(1)).cast("int")
    answers = missing.select(
        "*",
        F.when(digit < 7, F.concat(F.lit("id_"), "track_key")).alias("resolved_id"),
        F.when(digit < 4, F.concat(F.lit("id_"), "track_key")).alias("track_spotify_id"),
        F.when(digit < 4, digit / 10.0).alias("energy"),
    )
    return r6(lookup.upsert(known, lookup.track_answers(answers), "track_key"))


@query
def q_enrichment_users(spark, sf):
    """Users still to fetch, as a run over a log, landed pages and no profiles reports them."""
    path = f"{scratch_dir(spark)}"
    raw_play_lines(spark, sf).write.text(f"{path}/plays.tsv")
    out = run_enrichment(
        spark, f"{path}/out", as_of=as_of(), plays_tsv=f"{path}/plays.tsv", landed_pages=landed_pages(spark, sf),
        min_scrobbles=20,
    )
    return out["users_to_fetch"]


# -- diversity -------------------------------------------------------------------------


@query
def q_artist_play_counts(spark, sf):
    return rollups.artist_play_counts(m.plays_l(spark, sf))


def _artist(spark, sf, *cols):
    return r6(diversity.artist_diversity(m.plays_l(spark, sf)).select("userid", *cols))


@query
def q_unique_artists(spark, sf):
    return _artist(spark, sf, "unique_artists")


@query
def q_artist_entropy(spark, sf):
    return _artist(spark, sf, "artist_entropy")


@query
def q_artist_concentration(spark, sf):
    return _artist(spark, sf, "artist_concentration_20")


@query
def q_artist_diversity(spark, sf):
    return _artist(spark, sf, "unique_artists", "artist_entropy", "artist_concentration_20")


def _genre(spark, sf, *cols):
    block = diversity.genre_diversity(m.plays_l(spark, sf), m.artist_genres(spark, sf))
    return r6(block.select("userid", *cols))


@query
def q_avg_genre_tags_per_play(spark, sf):
    return _genre(spark, sf, "avg_genre_tags_per_play")


@query
def q_genre_play_counts(spark, sf):
    return diversity.genre_play_counts(m.plays_l(spark, sf), m.artist_genres(spark, sf))


@query
def q_unique_genres(spark, sf):
    return _genre(spark, sf, "unique_genres")


@query
def q_genre_entropy(spark, sf):
    return _genre(spark, sf, "genre_entropy")


@query
def q_genre_concentration(spark, sf):
    return _genre(spark, sf, "genre_concentration_5")


@query
def q_genre_diversity(spark, sf):
    return _genre(
        spark, sf, "unique_genres", "genre_entropy", "genre_concentration_5", "avg_genre_tags_per_play"
    )


# -- engagement ------------------------------------------------------------------------


@query
def q_total_scrobbles(spark, sf):
    return engagement.total_scrobbles(m.plays_l(spark, sf))


def _tracks(spark, sf, *cols):
    return r6(engagement.track_stats(m.plays_l(spark, sf)).select("userid", *cols))


@query
def q_unique_tracks(spark, sf):
    return _tracks(spark, sf, "unique_tracks")


@query
def q_track_replay_rate(spark, sf):
    return _tracks(spark, sf, "track_replay_rate")


@query
def q_top_artist_play_share(spark, sf):
    return _tracks(spark, sf, "top_artist_play_share")


@query
def q_session_count(spark, sf):
    clock = sessions.listening_clock(m.plays_e(spark, sf), 30)
    return clock.select("userid", F.col("sessions").alias("session_count"))


@query
def q_avg_tracks_per_session(spark, sf):
    clock = sessions.listening_clock(m.plays_e(spark, sf), GAP_6H)
    return r6(clock.select("userid", C.ratio(F.col("tracks"), F.col("sessions")).alias("avg_tracks_per_session")))


@query
def q_avg_session_length_min(spark, sf):
    clock = sessions.listening_clock(m.plays_e(spark, sf), GAP_6H)
    length = C.ratio(F.col("session_us") / 60_000_000.0, F.col("sessions"))
    return r6(clock.select("userid", length.alias("avg_session_length_min")))


@query
def q_discovery_velocity(spark, sf):
    return r6(engagement.discovery_velocity(m.plays_l(spark, sf), (30, 90, 180)))


@query
def q_novelty_ratio(spark, sf):
    return r6(engagement.engagement_features(m.plays_l(spark, sf)).select("userid", "novelty_ratio"))


@query
def q_engagement_features(spark, sf):
    return r6(engagement.engagement_features(m.plays_l(spark, sf), 30, (30, 90, 180), 90))


@query
def q_engagement_features_hours(spark, sf):
    """The same block on plays with a time of day, where the novelty window has an edge
    inside a slot."""
    return r6(engagement.engagement_features(m.plays_e(spark, sf), GAP_6H, (7, 14), 14))


@query
def q_audio_profile(spark, sf):
    return r6(audio.audio_profile(m.plays_l(spark, sf), m.audio_features(spark, sf)))


# -- rhythm ----------------------------------------------------------------------------


def _rhythm(spark, sf, *cols):
    block = temporal.temporal_features(m.plays_e(spark, sf), with_stability=False)
    return r6(block.select("userid", *cols))


@query
def q_hour_entropy(spark, sf):
    return _rhythm(spark, sf, "temporal_hour_entropy")


@query
def q_dow_entropy(spark, sf):
    return _rhythm(spark, sf, "temporal_dow_entropy")


@query
def q_month_entropy(spark, sf):
    block = temporal.temporal_features(m.plays_l(spark, sf), with_stability=False)
    return r6(block.select("userid", "temporal_month_entropy"))


@query
def q_daypart_ratios(spark, sf):
    return _rhythm(spark, sf, "morning_ratio", "evening_ratio")


@query
def q_weekend_ratio(spark, sf):
    return _rhythm(spark, sf, "weekend_ratio")


@query
def q_listening_days(spark, sf):
    return _rhythm(spark, sf, "listening_days")


@query
def q_avg_daily_plays(spark, sf):
    return _rhythm(spark, sf, "avg_daily_plays")


@query
def q_hour_profile(spark, sf):
    return r6(temporal.hour_profile(m.plays_e(spark, sf)))


@query
def q_temporal_features(spark, sf):
    """The whole block; its scores on principal axes, which SQL cannot give, are in ``temporal_pca``."""
    return r6(temporal.temporal_features(m.plays_e(spark, sf)).drop(*STABILITY))


@query
def q_temporal_pca(spark, sf):
    block = temporal.temporal_features(m.plays_e(spark, sf))
    return r6(block.select("userid", *STABILITY))


@query
def q_hour_axes(spark, sf):
    """The hour profile on as many axes as hold 60 % of its variance."""
    shares = staged(temporal.hour_profile(m.plays_e(spark, sf)))
    scaled, names = prep.preprocess(shares)
    scores, _ = prep.pca_reduce(prep.assemble(scaled, names), 0.6)
    return r6(_as_array(scores).select("userid", F.posexplode("features").alias("axis", "score")))


@query
def q_vector_plane(spark, sf):
    """The scatter of the given vectors: their first two axes, and the name of their cluster."""
    rows = m.vectors(spark, sf)
    mean = F.array(*[F.avg(F.col("features")[k]) for k in range(64)])
    centre = rows.agg(mean.alias("centre"))
    centred = rows.join(centre, F.lit(True)).select(
        "vec_id", F.zip_with("features", "centre", lambda a, b: a - b).alias("features"))
    plane = prep.embed_2d(quality.as_vectors(centred)).withColumnRenamed("vec_id", "userid")
    labelled = rows.select(F.col("vec_id").alias("userid"), "cluster", F.lit(None).cast("string").alias("cluster_name"))
    return r6(prof.scatter_rows(labelled.join(plane, "userid")).withColumnRenamed("userid", "vec_id"))


# -- matrix and exploration ------------------------------------------------------------


def _matrix(spark, sf, **options):
    return build_feature_matrix(
        m.plays_l(spark, sf), m.artist_genres(spark, sf), m.audio_features(spark, sf),
        m.profiles(spark, sf), **options,
    )


@query
def q_feature_matrix(spark, sf):
    return r6(_matrix(spark, sf).drop(*STABILITY))


@query
def q_feature_matrix_increments(spark, sf):
    """The matrix from roll-ups that were stored in three batches of plays."""
    plays, path = staged(m.plays_l(spark, sf), "zstd"), scratch_dir(spark)  # every batch reads it twice
    batch = F.pmod(F.xxhash64("userid", "timestamp", "track_name"), F.lit(3))
    for i in range(3):
        increments.add_batch(path, str(i), plays.where(batch == i))
    kept = increments.merged_rollups(spark, path, whole_tracks=False)
    return r6(_matrix(spark, sf, rollups=kept).drop(*STABILITY))


@query
def q_feature_matrix_full(spark, sf):
    """All 38 features, written and read back as the stage does."""
    return r6(m.saved_matrix(spark, sf))


@query
def q_dataset_summary(spark, sf):
    return explore.dataset_summary(
        m.plays_l(spark, sf), m.artist_genres(spark, sf), m.audio_features(spark, sf)
    )


def _features(matrix) -> list[str]:
    return C.numeric_columns(matrix, exclude=list(DEMOGRAPHICS))


@query
def q_feature_describe(spark, sf):
    matrix = m.saved_matrix(spark, sf)
    return r6(_comparable(explore.feature_describe(matrix, _features(matrix))))


@query
def q_feature_histogram(spark, sf):
    matrix = m.saved_matrix(spark, sf)
    return r6(_comparable(explore.feature_histogram(matrix, _features(matrix), 30)))


@query
def q_value_counts(spark, sf):
    p = m.profiles(spark, sf)
    gender = explore.value_counts(p, "gender").select(F.lit("gender").alias("column"), "value", "n")
    country = explore.value_counts(p, "country", 10).select(F.lit("country").alias("column"), "value", "n")
    return gender.unionByName(country)


def _correlations(spark, sf):
    """Of all 38 features; pairs with a principal score are left out of the compared rows."""
    pairs = explore.correlation_matrix(m.saved_matrix(spark, sf))
    return pairs.where(~F.col("feat_a").isin(STABILITY) & ~F.col("feat_b").isin(STABILITY))


@query
def q_correlation_matrix(spark, sf):
    return r6(_correlations(spark, sf).select("feat_a", "feat_b", "correlation"))


@query
def q_high_correlation_pairs(spark, sf):
    return r6(explore.high_correlation_pairs(_correlations(spark, sf), 0.75))


# -- sessions as rows ------------------------------------------------------------------


@query
def q_sessionize(spark, sf):
    out = sessions.sessionize(m.plays_e(spark, sf), 30)
    return r6(with_us(out.select("userid", "timestamp", "track_name", "session_id")))


@query
def q_session_table(spark, sf):
    """Lengths as whole microseconds: many of them are ties at six places of a minute."""
    table = sessions.session_table(m.plays_e(spark, sf), GAP_6H)
    length = F.round(F.col("duration_min") * 60_000_000).cast("bigint")
    return r6(table.select("userid", "session_id", "track_count", length.alias("duration_us")))


@query
def q_first_seen_artist(spark, sf):
    return with_us(rollups.first_seen_artist(m.plays_l(spark, sf)), "first_seen", "first_seen_us")


# -- sorts and top k -------------------------------------------------------------------


@query
def q_sort_plays(spark, sf):
    return with_us(parquet.sort_plays(m.plays_e(spark, sf)))


@query
def q_top_tracks_per_user(spark, sf):
    return topk.top_tracks_per_user(m.plays_l(spark, sf), 20)


@query
def q_tracks_to_enrich(spark, sf):
    return topk.tracks_to_enrich(m.plays_l(spark, sf), 20)


@query
def q_top_artists_by_period(spark, sf):
    """All six periods."""
    plays = m.plays_l(spark, sf)
    tables = [
        topk.top_artists_by_period(plays, as_of(), period, 5).withColumn("period", F.lit(period))
        for period in topk.PERIOD_DAYS
    ]
    return reduce(DataFrame.unionByName, tables)


@query
def q_top_n_genres(spark, sf):
    return topk.top_genres(m.plays_l(spark, sf), m.artist_genres(spark, sf), 10)


# -- set operations --------------------------------------------------------------------


def overlapping_sources(spark, sf) -> list[DataFrame]:
    """The log with ids, and recent plays that repeat its later half without ids."""
    log = m.plays_l(spark, sf).withColumn("artist_mbid", F.lit("id"))
    recent = m.plays_l(spark, sf).where(F.col("timestamp") >= "1998-01-01")
    return [log, recent]


@query
def q_merge_dedup(spark, sf):
    return with_us(ingest.merge_dedup(overlapping_sources(spark, sf)))


@query
def q_union_users(spark, sf):
    return with_us(ingest.union_users([m.plays_l(spark, sf), m.plays_e(spark, sf)]))


@query
def q_distinct_artists(spark, sf):
    return lookup.distinct_artists(m.plays_l(spark, sf))


# -- scalars ---------------------------------------------------------------------------


@query
def q_scalar_checks(spark, sf):
    """Text, date, math, array and cast expressions over the order lines."""
    plays = m.plays_l(spark, sf)
    genres = m.artist_genres(spark, sf)
    joined = diversity.genre_join(rollups.artist_rollup(plays), genres)
    t = F.timestamp_micros("first_us")
    return r6(
        joined.select(
            "userid",
            "artist_name",
            C.artist_key(F.concat(F.lit(" "), "artist_name")).alias("key"),
            F.hour(t).alias("hour"),
            F.weekday(t).alias("dow"),
            F.month(t).alias("month"),
            F.to_date(t).cast("string").alias("day"),
            F.size("genres").alias("tags"),
            F.log2("plays").alias("log_plays"),
            C.ratio(F.col("plays"), F.size("genres")).alias("plays_per_tag"),
            F.col("userid").try_cast("double").alias("user_number"),
            F.col("artist_name").try_cast("double").alias("not_a_number"),
        )
    )


# -- preprocessing and clustering ------------------------------------------------------


@query
def q_median_impute(spark, sf):
    imputed, _ = prep.median_impute(m.saved_matrix(spark, sf))
    return r6(imputed.drop(*STABILITY))


@query
def q_standard_scale(spark, sf):
    scaled, _ = prep.preprocess(m.saved_matrix(spark, sf))
    return r6(scaled.drop(*STABILITY))


def user_vectors(spark, sf) -> DataFrame:
    scaled, names = prep.preprocess(m.saved_matrix(spark, sf))
    return prep.assemble(scaled, names)


def _as_array(df: DataFrame) -> DataFrame:
    return df.withColumn("features", vector_to_array("features"))


def _batch_products(batches):
    """Sums and sums of products of every two axes, for users with ``m`` rows and the sums of these:
    each row of a user meets all rows of that user."""
    import pandas as pd

    for pdf in batches:
        if not len(pdf):
            continue
        scores, m_ = np.stack(pdf["features"].to_numpy()), pdf["m"].to_numpy(dtype=float)
        one, two = np.triu_indices(scores.shape[1], 1)
        total, products = m_ @ scores, scores.T @ scores
        yield pd.DataFrame(
            {"one": one, "two": two, "n": m_ @ m_, "x": total[one], "y": total[two], "xy": products[one, two]}
        )


def axis_covariances(reduced: DataFrame) -> DataFrame:
    """(one, two, c): the covariance of every two axes over the rows that share a user."""
    rows = reduced.where(F.col("userid").isNotNull()).select("userid", "features")
    repeated = staged(rows.groupBy("userid").agg(F.count("*").alias("m")).where(F.col("m") > 1))
    alone = rows.join(repeated, "userid", "left_anti").select("features", F.lit(1).cast("bigint").alias("m"))
    added = (
        rows.join(repeated, "userid").select("userid", "m", F.posexplode("features").alias("axis", "score"))
        .groupBy("userid", "m", "axis").agg(F.sum("score").alias("score"))
        .groupBy("userid", "m").agg(F.sort_array(F.collect_list(F.struct("axis", "score"))).alias("scores"))
        .select(F.col("scores.score").alias("features"), "m")
    )
    sums = alone.union(added).mapInPandas(_batch_products, "one int, two int, n double, x double, y double, xy double")
    n, x, y, xy = (F.sum(c) for c in ("n", "x", "y", "xy"))
    return sums.groupBy("one", "two").agg(F.try_divide(xy - x * y / n, n - 1).alias("c"))


@query
def q_pca_facts(spark, sf):
    """What must hold for principal scores, whatever their signs: as many users as rows, all
    axes kept give the variance of the scaled features back, and no two axes correlate."""
    vectors = staged(user_vectors(spark, sf))
    reduced, _ = prep.pca_reduce(vectors, 1.0)
    reduced = staged(_as_array(reduced))
    scores = reduced.select("userid", F.posexplode("features").alias("axis", "score"))
    total = scores.groupBy("axis").agg(F.var_samp("score").alias("v")).agg(F.sum("v").alias("v"))
    given = _as_array(vectors).select(F.posexplode("features").alias("axis", "score"))
    given = given.groupBy("axis").agg(F.var_samp("score").alias("v")).agg(F.sum("v").alias("w"))
    pairs = axis_covariances(reduced).agg(F.count(F.when(F.abs("c") > 1e-6, 1)).alias("correlated"))
    users = scores.agg(F.count_distinct("userid").alias("users"))
    numbers = [df.first()[0] for df in (users, total, given, pairs)]
    lost = abs(numbers[1] - numbers[2]) > 1e-6 * numbers[2]
    return spark.range(1).select(
        F.lit(numbers[0]).alias("users"), F.lit(int(lost)).cast("bigint").alias("variance_lost"),
        F.lit(numbers[3]).alias("correlated"),
    )


@query
def q_pca_reduce(spark, sf):
    reduced, _ = prep.pca_reduce(user_vectors(spark, sf), 0.95)
    long = _as_array(reduced).select("userid", F.posexplode("features").alias("axis", "score"))
    return r6(long)


def once(fn):
    """``fn`` remembered until the scratch tables are released."""
    kept = lru_cache(maxsize=None)(fn)
    on_release(kept.cache_clear)
    return kept


@once
def _sweep(app: str, spark, sf):
    """The whole sweep, k 3 to 10 with 20 starts each, fitted once per application."""
    space = staged(prep.pca_reduce(user_vectors(spark, sf), 0.95)[0])
    return space, cluster.kmeans_sweep(space)


def sweep(spark, sf):
    return _sweep(spark.sparkContext.applicationId, spark, sf)


@query
def q_kmeans_sweep(spark, sf):
    return sweep(spark, sf)[1].labels


@query
def q_elbow_table(spark, sf):
    fitted = sweep(spark, sf)[1]
    return quality.elbow_table(spark, fitted.inertias, fitted.silhouettes)


@query
def q_kmeans_facts(spark, sf):
    """What must hold for a sweep, whatever the start: every user has one label, all k were
    tried, nobody is nearer to another centre, no larger k costs more than 1 % more, and the
    vectors were read as often as the slowest model has rounds."""
    space, fitted = sweep(spark, sf)
    centres = [[float(v) for v in c] for c in fitted.models[fitted.best_k].centres]
    point = vector_to_array("features")
    away = F.array(*[
        F.aggregate(
            F.zip_with(point, F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0), lambda total, v: total + v,
        )
        for c in centres
    ])
    placed = space.join(fitted.labels, "userid").select("userid", "cluster", away.alias("away"))
    own = F.element_at("away", F.col("cluster") + 1)
    costs = [fitted.inertias[k] for k in sorted(fitted.inertias)]
    return placed.agg(
        F.count("*").alias("users"),
        F.count_distinct("userid").alias("labelled"),
        F.count(F.when(own > F.array_min("away") + 1e-6, 1)).alias("nearer_elsewhere"),
    ).select(
        "users", "labelled", "nearer_elsewhere",
        F.lit(len(costs)).cast("bigint").alias("tried"),
        F.lit(sum(b > 1.01 * a for a, b in zip(costs, costs[1:]))).cast("bigint").alias("rising"),
        F.lit(fitted.reads - fitted.rounds).cast("bigint").alias("extra_reads"),
    )


def given_models(spark, sf) -> tuple[DataFrame, dict]:
    """Models of three sizes, started at the first vectors, after twelve rounds together."""
    rows = m.vectors(spark, sf)
    first = [r["features"] for r in rows.orderBy("vec_id").limit(6).collect()]
    fits = {k: cluster.Model(np.array(first[:k])) for k in (2, 4, 6)}
    arrays = point_arrays(rows.select("vec_id", "features"), "vec_id")
    cluster.advance(arrays, fits, -1.0, 12)
    return arrays, fits


def labelled_by_given_models(spark, sf) -> DataFrame:
    arrays, fits = given_models(spark, sf)
    return staged(cluster.labelled(arrays, list(fits.values())).withColumnsRenamed({"id": "userid", "x": "features"}))


def of_model(marked: DataFrame, position: int) -> DataFrame:
    return marked.select("userid", "features", F.get("labs", F.lit(position)).alias("cluster"))


@query
def q_elbow_given(spark, sf):
    """The curve of the given models, their costs and silhouettes taken from their labels."""
    marked = labelled_by_given_models(spark, sf)
    scores = quality.silhouette_by_labelling(marked)
    costs = {k: quality.inertia(of_model(marked, i)) for i, k in enumerate((2, 4, 6))}
    return r6(quality.elbow_table(spark, costs, {k: scores[i] for i, k in enumerate((2, 4, 6))}))


@query
def q_model_choice(spark, sf):
    """The scores of the given models side by side."""
    marked = labelled_by_given_models(spark, sf)
    results = [
        SimpleNamespace(scores=plan_clustering.score_table(f"KMeans (k={k})", of_model(marked, i), k, 0, "exact"))
        for i, k in enumerate((2, 4, 6))
    ]
    return r6(plan_clustering.compare(results))


@query
def q_kmeans_rounds(spark, sf):
    """The given models: members, cost and place of their centres."""
    _, fits = given_models(spark, sf)
    table = [
        (k, c, int(fit.sizes[c]), float(fit.cost), float((fit.centres[c] ** 2).sum()))
        for k, fit in fits.items()
        for c in range(k)
    ]
    return r6(spark.createDataFrame(table, "k int, centre int, members bigint, cost double, square double"))


@query
def q_density_cluster(spark, sf):
    return r6(density.density_cluster(m.vectors(spark, sf), 1.165, 5, 5, "vec_id"))


@query
def q_density_auto(spark, sf):
    return r6(hierarchy.density_hierarchy(m.vectors(spark, sf), 5, 5, "vec_id").labels)


@query
def q_density_hierarchy(spark, sf):
    return r6(hierarchy.density_hierarchy(m.vectors(spark, sf), 5, 5, "vec_id").clusters)


@query
def q_core_distance(spark, sf):
    return r6(density.neighbour_distances(m.vectors(spark, sf), 5, "vec_id"))


@query
def q_embed_2d(spark, sf):
    return r6(prep.embed_2d(user_vectors(spark, sf)))


@query
def q_clustering_pipeline(spark, sf):
    return _run(spark.sparkContext.applicationId, spark, sf, "kmeans").assignments


@once
def _run(app: str, spark, sf, algorithm: str):
    """A run with all defaults, made once per application."""
    return plan_clustering.run_clustering(m.saved_matrix(spark, sf), algorithm)


@query
def q_model_selection(spark, sf):
    app = spark.sparkContext.applicationId
    return plan_clustering.compare([_run(app, spark, sf, kind) for kind in ("kmeans", "density")])


@query
def q_pipeline_facts(spark, sf):
    """One label per user, and a score that is that of its labels when taken anew."""
    result = _run(spark.sparkContext.applicationId, spark, sf, "kmeans")
    points = result.space.join(result.assignments.select("userid", "cluster"), "userid")
    again = {
        "silhouette": quality.silhouette_exact(points).first()["silhouette"],
        "davies_bouldin": quality.davies_bouldin(points),
        "calinski_harabasz": quality.calinski_harabasz(points),
    }
    off = sum(abs(again[k] - result.score[k]) > 1e-6 * max(1.0, abs(again[k])) for k in again)
    return points.agg(
        F.count("*").alias("users"),
        F.count_distinct("userid").alias("labelled"),
        F.count(F.when(F.col("cluster") < 0, 1)).alias("noise"),
        F.lit(off).cast("bigint").alias("scores_off"),
    )


# -- quality ---------------------------------------------------------------------------


@query
def q_silhouette_exact(spark, sf):
    return r6(quality.silhouette_exact(m.vectors(spark, sf), "vec_id"))


@query
def q_silhouette_samples(spark, sf):
    return r6(quality.silhouette_samples(m.vectors(spark, sf), "vec_id"))


@query
def q_silhouette_squared(spark, sf):
    return r6(quality.quality_row(spark, silhouette=quality.silhouette_squared(m.vectors(spark, sf))))


@query
def q_davies_bouldin(spark, sf):
    return r6(quality.quality_row(spark, davies_bouldin=quality.davies_bouldin(m.vectors(spark, sf))))


@query
def q_calinski_harabasz(spark, sf):
    value = quality.calinski_harabasz(m.vectors(spark, sf))
    return r6(quality.quality_row(spark, calinski_harabasz=value))


@query
def q_inertia(spark, sf):
    return r6(quality.quality_row(spark, inertia=quality.inertia(m.vectors(spark, sf))))


@query
def q_silhouette_stability(spark, sf):
    return r6(quality.silhouette_stability(m.vectors(spark, sf), 50, 0.8, "vec_id"))


@query
def q_feature_importance(spark, sf):
    return _importances(spark, sf)


@once
def _forest(app: str, spark, sf):
    forest, names = importance.cluster_forest(m.saved_matrix(spark, sf), m.labels(spark, sf))
    return staged(forest), names


def _importances(spark, sf):
    """The whole forest, 200 full trees, grown once per application."""
    table = importance.importances(*_forest(spark.sparkContext.applicationId, spark, sf))
    return table.orderBy(F.desc("importance"), "feature")


@query
def q_top_importances(spark, sf):
    return importance.top_importances(_importances(spark, sf), 10)


@query
def q_importance_facts(spark, sf):
    """One row per feature, shares that sum to one, none below zero. All trees are there, what
    their splits take is the impurity of the root, and nothing of it is left in the leaves."""
    shares = _importances(spark, sf).agg(
        F.count("*").alias("features"),
        F.count_distinct("feature").alias("named"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.count(F.when(F.col("importance") < 0, 1)).alias("negative"),
    )
    taken = F.aggregate("decreases", F.lit(0.0), lambda a, b: a + b)
    trees = _forest(spark.sparkContext.applicationId, spark, sf)[0].agg(
        F.count("*").alias("trees"),
        F.count(F.when(F.abs(taken - F.col("root")) > 1e-6 * F.col("root"), 1)).alias("lost"),
        F.count(F.when(F.col("left_over") > 1e-6, 1)).alias("impure"),
    )
    return shares.join(trees, F.lit(True))


# -- profiles --------------------------------------------------------------------------


def _report_matrix(spark, sf):
    return m.saved_matrix(spark, sf)


def _comparable(df: DataFrame) -> DataFrame:
    """Without the rows of the principal scores, which SQL cannot give."""
    return df.where(~F.col("feature").isin(STABILITY))


@query
def q_cluster_summary(spark, sf):
    return r6(_comparable(prof.cluster_summary(_report_matrix(spark, sf), m.labels(spark, sf))))


@query
def q_cluster_names(spark, sf):
    return r6(prof.cluster_names(_report_matrix(spark, sf), m.labels(spark, sf)))


@query
def q_cluster_labels(spark, sf):
    return r6(labelled(spark, sf))


@query
def q_cluster_zscore_heatmap(spark, sf):
    return r6(_comparable(prof.cluster_zscore_heatmap(_report_matrix(spark, sf), m.labels(spark, sf))))


@query
def q_cluster_radar(spark, sf):
    features = ["artist_entropy", "genre_entropy", "novelty_ratio", "track_replay_rate", "no_such_feature"]
    summary = prof.cluster_summary(_report_matrix(spark, sf), m.labels(spark, sf), features[:-1])
    return r6(prof.cluster_radar(summary, features))


@query
def q_genre_share_by_cluster(spark, sf):
    return r6(
        prof.genre_share_by_cluster(m.plays_l(spark, sf), m.artist_genres(spark, sf), m.labels(spark, sf), 10)
    )


@query
def q_activity_heatmap(spark, sf):
    return r6(prof.activity_heatmap(m.plays_e(spark, sf), m.labels(spark, sf)))


@query
def q_segment_report(spark, sf):
    return r6(prof.segment_report(_report_matrix(spark, sf), m.labels(spark, sf)))


@query
def q_segment_recommendations(spark, sf):
    report = prof.segment_report(_report_matrix(spark, sf), m.labels(spark, sf))
    return r6(prof.segment_recommendations(report))


def _demographics(spark, sf):
    return prof.demographic_join(labelled(spark, sf), m.profiles(spark, sf))


@query
def q_gender_by_cluster(spark, sf):
    return r6(prof.gender_by_cluster(_demographics(spark, sf)))


@query
def q_median_age_by_cluster(spark, sf):
    return r6(prof.median_age_by_cluster(_demographics(spark, sf)))


@query
def q_top_countries_per_cluster(spark, sf):
    return prof.top_countries_per_cluster(_demographics(spark, sf))


@query
def q_umap_scatter_rows(spark, sf):
    names = prof.cluster_names(_report_matrix(spark, sf), m.labels(spark, sf))
    plane = prep.embed_2d(user_vectors(spark, sf))
    return r6(prof.scatter_rows(prof.cluster_labels(m.labels(spark, sf), names, plane)))


@query
def q_cluster_sizes(spark, sf):
    return r6(prof.cluster_sizes(m.labels(spark, sf)))


# -- the user supplied lookup ----------------------------------------------------------


def lookup_by_number(rows: list[dict]) -> list[dict | None]:
    """A stand-in lookup: artists with a number divisible by three are not found."""
    out: list[dict | None] = []
    for row in rows:
        number = int(row["artist_key"][1:])
        found = {"spotify_artist_id": f"a{number}", "genres": [f"g{number % 5}"], "popularity": number % 100}
        out.append(found if number % 3 else None)
    return out


@query
def q_enrich_with(spark, sf):
    nothing_known = parquet.read_or_empty(spark, None, ARTIST_GENRES)
    missing = lookup.missing_artists(m.plays_l(spark, sf), nothing_known)
    rows = lookup.artist_answers(lookup.enrich_with(missing, lookup_by_number, ARTIST_ANSWER))
    return r6(rows.withColumn("genres", F.array_join("genres", "/", "?")))
