"""Shards that all hold the mixture of the whole table.

Rows are shuffled inside their stratum by a seeded hash and ranked there. The fractional rank
of a row says where it stands among all shards: its whole part is a shard, the rest a place in
it. Of a stratum with q * shards + r rows (r < shards) the first q * shards take the ranks
(i + 1/2) / q, so every shard gets q of them at even distances. The r rows left start where
the stratum before ended: the one at position g of the whole order (stratum, draw) belongs to
shard g modulo ``shards``, at a place given by its draw. The cut at whole ranks then gives
every shard q or q + 1 rows of every stratum, and shards that differ by one row at most,
whatever the number and the sizes of the strata.

Both rankings are range sorts of narrow rows (no texts), numbered from the row counts of the
sorted partitions; no stratum meets in one task and no window runs over one. The numbered
table is written to the shared folder between the steps, so a lost executor costs a re-read.

A null stratum is a stratum of its own. Null ids and texts are allowed (a null text has no
bytes). Repeated rows are interchangeable and each gets its own slot. An empty table gives an
empty table. With fewer rows than shards some shards stay empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playcohort.llm.common import text_of
from playcohort.session import staged

#: Bits of monotonically_increasing_id() that count inside a partition.
ROW_BITS = 33
#: Steps that a draw is mapped to when it gives a place inside a shard.
PLACES = 1 << 30


def numbered(df: DataFrame, order: list[str], within: str) -> DataFrame:
    """``df`` with ``position``, the 0-based position in the order of ``order``, and, inside each
    value of ``within`` (the first column of ``order``), ``rank`` from 0 and ``total``, its rows."""
    placed = staged(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", ROW_BITS)
    # One row per sorted partition.
    runs = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(
        runs.select("_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    at = placed.join(starts, part == F.col("_part")).withColumn("position", F.col("_at") + F.col("_shift"))
    at = at.drop("_at", "_part", "_shift")
    sizes = at.groupBy(F.col(within).alias("_within")).agg(
        F.count("*").alias("total"), F.min("position").alias("_start")
    )
    return (
        at.join(sizes, F.col(within).eqNullSafe(F.col("_within")))
        .withColumn("rank", F.col("position") - F.col("_start"))
        .drop("_within", "_start")
    )


def proportional_shards(
    docs: DataFrame,
    n_shards: int,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
) -> DataFrame:
    """Columns ``id_col``, ``stratum_col``, ``text_crc32``, ``n_bytes``, ``shard``, ``slot``.

    ``slot`` numbers the rows of a shard from 0 without gaps. One row per row of ``docs``.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = text_of(text_col)
    rows = docs.select(
        F.col(stratum_col).alias("stratum"),
        F.col(id_col).alias("id"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ).withColumn("draw", F.xxhash64(F.lit(seed), "id", "text_crc32", "n_bytes"))
    shuffled = numbered(rows, ["stratum", "draw", "id"], within="stratum")
    each = F.expr(f"total div {n_shards}")
    even = F.col("rank") < F.col("each") * n_shards
    ranked = shuffled.withColumn("each", each).select(
        "stratum",
        "id",
        "text_crc32",
        "n_bytes",
        "draw",
        F.when(even, F.expr("rank div each")).otherwise(F.col("position") % n_shards).cast("int").alias("shard"),
        F.when(even, (F.expr("rank % each") + 0.5) / F.col("each"))
        .otherwise((F.pmod("draw", F.lit(PLACES)) + 0.5) / PLACES)
        .alias("place"),
    )
    mixed = numbered(ranked, ["shard", "place", "draw", "stratum", "id"], within="shard")
    return mixed.select(
        F.col("id").alias(id_col),
        F.col("stratum").alias(stratum_col),
        "text_crc32",
        "n_bytes",
        "shard",
        F.col("rank").alias("slot"),
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of ``docs`` as one folder per shard, sorted by slot inside its files.

    ``id_col`` must identify a row of ``docs``. A shard is written by the tasks of its
    slot range, so large shards give several files.
    """
    placed = shards.select(F.col(id_col).alias("_id"), "shard", "slot")
    rows = docs.join(placed, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
