"""Parquet tables, user samples and user lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A saved table; Spark raises where the path does not exist."""
    return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """A saved table, or an empty one where there is no earlier path."""
    return spark.read.parquet(path) if path else spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, by: list[str], sort_within: list[str] = ()) -> None:
    """Write ranges of the leading column as sorted files.

    Files then hold disjoint key ranges, so later filters skip most of them. All sort
    columns take part in the ranges: one user with very many plays spans several files.
    """
    order = [*by, *[c for c in sort_within if c not in by]]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def sort_plays(plays: DataFrame) -> DataFrame:
    return plays.orderBy("userid", "timestamp")


def sample_users(plays: DataFrame, n_users: int = 50, seed: int = 42) -> DataFrame:
    """All plays of ``n_users`` users chosen by hash; all users if there are fewer.

    The limit over the ordered distinct users runs as a distributed top n.
    """
    users = plays.select("userid").where(F.col("userid").isNotNull()).distinct()
    rank = F.md5(F.concat(F.col("userid"), F.lit(f"_{seed}")))
    chosen = users.orderBy(rank, "userid").limit(n_users)
    return plays.join(chosen, "userid", "left_semi")


def user_universe(profiles: DataFrame | None, plays: DataFrame | None = None) -> DataFrame:
    """Distinct user ids of the profiles, else of the plays."""
    source = profiles if profiles is not None else plays
    if source is None:
        raise ValueError("neither profiles nor plays given: no users to work on")
    return source.select("userid").dropna().distinct()
