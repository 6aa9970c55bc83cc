"""Lookup tables: which keys are missing, asking for them in batches, and keeping answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from playcohort.functions.columns import artist_key, track_key
from playcohort.session import path_exists, staged

BATCH_SIZE = 50
#: Batches that one job asks for; what it has answered is kept whatever happens later.
WAVE_BATCHES = 2000
#: Folders that a stored lookup table is dealt into by its key.
PARTS = 64


def distinct_artists(plays: DataFrame) -> DataFrame:
    return plays.select("artist_name").dropna().distinct()


def missing_artists(plays: DataFrame, cache: DataFrame) -> DataFrame:
    """(artist_key, artist_name) of the artists whose key the cache lacks, one row per key.

    Spellings that share a key are reduced to one, the smallest.
    """
    wanted = (
        plays.where(F.col("artist_name").isNotNull())
        .groupBy(artist_key(F.col("artist_name")).alias("artist_key"))
        .agg(F.min("artist_name").alias("artist_name"))
    )
    known = cache.select(F.col("artist_name_normalized").alias("artist_key"))
    return wanted.join(known, "artist_key", "left_anti")


def missing_tracks(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """(track_key, artist_name, track_name) of the pairs whose key the cache lacks."""
    spelling = F.min(F.struct("artist_name", "track_name"))
    wanted = (
        pairs.dropna(subset=["artist_name", "track_name"])
        .groupBy(track_key(F.col("artist_name"), F.col("track_name")).alias("track_key"))
        .agg(spelling.alias("s"))
        .select("track_key", "s.artist_name", "s.track_name")
    )
    return wanted.join(cache.select("track_key"), "track_key", "left_anti")


def upsert(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row per key out of a cache and new answers; the new answer wins.

    Repeated rows of one side are settled by their content, so a rerun gives the same
    table. Columns one side lacks are null there.
    """
    both = cache.withColumn("_rank", F.lit(1)).unionByName(
        new.withColumn("_rank", F.lit(0)), allowMissingColumns=True
    )
    columns = [c for c in both.columns if c != "_rank"]
    content = [F.asc_nulls_last(c) for c in columns if c != key]
    w = Window.partitionBy(key).orderBy("_rank", *content)
    first = both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return first.select(*columns)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table kept by ``upsert_stored``; an empty one before its first rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path).drop("_part")


def upsert_stored(path: str, new: DataFrame, key: str, schema: T.StructType, parts: int = PARTS) -> list[int]:
    """``upsert`` into a table at ``path`` that is dealt into folders by a hash of its key. Only the
    folders of keys in ``new`` are read and written again; returns their numbers.

    ``parts`` must stay the same for a table. The merged rows are written aside first, so the
    folders are replaced from a table that no longer reads them.
    """
    spark = new.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    fresh = staged(new.select(*schema.names).withColumn("_part", part))
    touched = sorted(r["_part"] for r in fresh.select("_part").distinct().collect())
    if not touched:
        return []
    old = fresh.limit(0)
    if path_exists(spark, path):
        whole = T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])
        old = spark.read.schema(whole).parquet(path).where(F.col("_part").isin(touched))
    merged = staged(upsert(old.drop("_part"), fresh.drop("_part"), key))
    (
        merged.withColumn("_part", part)
        .repartition("_part")
        .sortWithinPartitions("_part", key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("_part")
        .parquet(path)
    )
    return touched


def artist_answers(answers: DataFrame) -> DataFrame:
    """Artist answers as cache rows; an artist not found is kept with a null id and no
    genres, so it is not asked for again."""
    return answers.select(
        F.col("artist_key").alias("artist_name_normalized"),
        F.col("spotify_artist_id"),
        F.when(F.col("spotify_artist_id").isNotNull(), F.coalesce("genres", F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>"))
        .alias("genres"),
        F.when(F.col("spotify_artist_id").isNotNull(), F.col("popularity")).alias("popularity"),
    )


def track_answers(answers: DataFrame) -> DataFrame:
    """Track answers as cache rows. ``resolved_id`` is the id the key led to: without it a
    key is not kept and will be asked for again; with it but without features (a null
    ``track_spotify_id``) the key is kept as an empty row."""
    return answers.where(F.col("resolved_id").isNotNull()).drop(
        "resolved_id", "artist_name", "track_name"
    )


def enrich_with(
    keys: DataFrame,
    fetch: Callable[[list[dict]], Sequence[dict | None]],
    answer: T.StructType,
    batch_size: int = BATCH_SIZE,
    halve: bool = False,
) -> DataFrame:
    """Ask ``fetch`` for every row of ``keys``, ``batch_size`` rows per call.

    ``fetch`` gets rows as dicts and returns one dict or None per row, in order. A batch that
    raises, or an answer that is None, gives nulls for those rows instead of failing the job.
    With ``halve`` a batch that raises is asked again in halves, so that one bad key costs its
    own answer only. Answers carry the key columns along.
    """
    import pandas as pd

    key_names = keys.columns
    names = answer.names
    schema = T.StructType(list(keys.schema.fields) + list(answer.fields))

    def replies(part: list[dict]) -> list[dict | None]:
        try:
            got = list(fetch(part))
            if len(got) != len(part):
                raise ValueError("one reply per key is needed")
            return got
        except Exception:  # noqa: BLE001 - what fails becomes null answers
            if not halve or len(part) == 1:
                return [None] * len(part)
            middle = len(part) // 2
            return replies(part[:middle]) + replies(part[middle:])

    def ask(batches):
        for pdf in batches:
            rows = pdf.to_dict("records")
            got: list[dict] = []
            for start in range(0, len(rows), batch_size):
                got += [reply or {} for reply in replies(rows[start : start + batch_size])]
            out = {k: pdf[k].tolist() for k in key_names}
            for n in names:
                out[n] = pd.Series([g.get(n) for g in got], dtype=object)
            yield pd.DataFrame(out, columns=key_names + names)

    return keys.mapInPandas(ask, schema)


def enrich_stored(
    keys: DataFrame,
    fetch: Callable[[list[dict]], Sequence[dict | None]],
    answer: T.StructType,
    path: str,
    batch_size: int = BATCH_SIZE,
    wave_batches: int = WAVE_BATCHES,
) -> DataFrame:
    """``enrich_with`` (with ``halve``) whose answers are kept at ``path`` as they come in.

    A task asks for one batch and commits its file in the shared folder; nothing is computed
    from a finished task again, so a lost executor repeats the batches it was at. Keys are
    asked for in jobs of ``wave_batches`` batches, and keys with an answer at ``path`` are not
    asked for at all: a run that starts anew goes on after the last finished job.
    """
    spark = keys.sparkSession
    names = keys.columns
    schema = T.StructType(list(keys.schema.fields) + list(answer.fields))

    def answered() -> DataFrame:
        if not path_exists(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path)

    def open_keys(of: DataFrame) -> DataFrame:
        known = answered().select(*[F.col(n).alias(f"_{n}") for n in names])
        same = F.lit(True)
        for n in names:
            same &= F.col(n).eqNullSafe(F.col(f"_{n}"))
        return of.join(known, same, "left_anti")

    left = staged(open_keys(keys.distinct()))
    waves = -(-left.count() // (batch_size * wave_batches))
    for wave in range(waves):
        part = left.where(F.pmod(F.xxhash64(*names, F.lit("wave")), F.lit(waves)) == wave)
        batches = max(1, -(-part.count() // batch_size))
        enrich_with(part.repartition(batches), fetch, answer, batch_size, halve=True).write.mode("append").parquet(path)
    return keys.join(answered(), names, "left")
