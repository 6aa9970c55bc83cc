"""Putting user tables together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from playcohort.schemas import DEMOGRAPHICS


def join_feature_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """Full outer join of blocks with one row per user each.

    Written as union and group by: one exchange for all blocks, where chained full outer
    joins would shuffle the growing result again for every block.
    """
    merged = blocks[0]
    for block in blocks[1:]:
        merged = merged.unionByName(block, allowMissingColumns=True)
    columns = [c for c in merged.columns if c != "userid"]
    return merged.groupBy("userid").agg(*[F.max(c).alias(c) for c in columns])


def join_profiles(matrix: DataFrame, profiles: DataFrame) -> DataFrame:
    """The matrix with gender, age and country where known."""
    return matrix.join(profiles.select("userid", *DEMOGRAPHICS), "userid", "left")


def join_cluster_labels(plays: DataFrame, labels: DataFrame) -> DataFrame:
    """Each play with the cluster of its user, null for users without one."""
    return plays.join(labels.select("userid", "cluster"), "userid", "left")


def keep_users(plays: DataFrame, users: DataFrame) -> DataFrame:
    return plays.join(users.select("userid"), "userid", "left_semi")
