"""Stored roll-ups of the plays that grow by the new plays only.

Counts add up and first and last instants combine, so the roll-up of a history is the merge of
the roll-ups of its parts. Every batch of new plays appends its own; reading merges them.
Batches must not share plays (``merge_dedup`` before, where sources overlap).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from playcohort.operators.rollups import slot_rollup, slot_width, track_rollup

SLOT_KEYS = ("userid", "slot")
TRACK_KEYS = ("userid", "artist_name", "track_name")
SLOTS = "userid string, slot bigint, plays bigint, tracks bigint, first_us bigint, last_us bigint"
TRACKS = "userid string, artist_name string, track_name string, plays bigint, first_us bigint"


def _folders(path: str, gap_minutes: float) -> tuple[str, str]:
    return f"{path}/slots_{slot_width(gap_minutes)}", f"{path}/tracks"


def add_batch(path: str, batch: str, new_plays: DataFrame, gap_minutes: float = 30) -> None:
    """Store the roll-ups of ``new_plays`` as ``batch``. Repeating a batch, say after a
    failure, replaces it. A history is kept for one session gap."""
    slots, tracks = _folders(path, gap_minutes)
    named = F.lit(batch).alias("batch")
    for rows, folder in ((track_rollup(new_plays), tracks), (slot_rollup(new_plays, gap_minutes), slots)):
        writer = rows.select("*", named).write.mode("overwrite").option("compression", "zstd").partitionBy("batch")
        writer.option("partitionOverwriteMode", "dynamic").parquet(folder)


def merged_rollups(
    spark: SparkSession, path: str, gap_minutes: float = 30, whole_tracks: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The slot and the track roll-up of all batches, as ``build_feature_matrix`` takes them. It adds
    tracks up by user itself, so without ``whole_tracks`` they keep a row per batch."""
    slots, tracks = _folders(path, gap_minutes)
    counted = [F.sum("plays").alias("plays")]
    first = F.min("first_us").alias("first_us")
    kept = spark.read.schema(f"{TRACKS}, batch string").parquet(tracks)
    return (
        spark.read.schema(f"{SLOTS}, batch string").parquet(slots).groupBy(*SLOT_KEYS)
        .agg(*counted, F.sum("tracks").alias("tracks"), first, F.max("last_us").alias("last_us")),
        kept.groupBy(*TRACK_KEYS).agg(*counted, first) if whole_tracks else kept.drop("batch"),
    )


def compact(spark: SparkSession, path: str, target: str, gap_minutes: float = 30) -> None:
    """Write the merge of all batches to ``target`` as one batch ``base``, to go on from there."""
    for rows, folder in zip(merged_rollups(spark, path, gap_minutes), _folders(target, gap_minutes)):
        rows.withColumn("batch", F.lit("base")).write.mode("overwrite").partitionBy("batch").parquet(folder)
