"""Density clustering at one radius.

Points with at least ``min_samples`` others within ``eps`` are dense; dense points within
``eps`` of each other share a cluster; a cluster below ``min_cluster_size`` and every point
that is not dense are noise (-1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playcohort.operators.pairwise import (
    BLOCK_ROWS,
    near_strips,
    nearest,
    nearest_within,
    over_block_pairs,
    over_meeting_blocks,
    pivot_blocks,
    point_arrays,
    reach_of_blocks,
)
from playcohort.operators.topk import head_per_group
from playcohort.session import cut_lineage, staged


def neighbour_distances(
    points: DataFrame, min_samples: int = 5, id_col: str = "userid", block_rows: int | None = None
) -> DataFrame:
    """(id, core_distance): distance to the ``min_samples``-th nearest other point, null for
    fewer points.

    Points are dealt into blocks around pivots. Inside its block every point finds a first
    bound for its distance; two blocks then meet only if the triangle inequality lets a point
    of one lie within the largest bound of the other. A meeting passes on at most
    ``min_samples`` candidates per point, none beyond the bound of the point.
    """
    arrays = point_arrays(points.select(id_col, "features"), id_col)
    id_type = arrays.schema["id"].dataType.simpleString()
    count = arrays.count()
    if count <= min_samples:
        return points.select(id_col, F.lit(None).cast("double").alias("core_distance"))
    blocks = pivot_blocks(arrays, count, block_rows)

    def inside(pdf):
        import numpy as np
        import pandas as pd

        x = np.stack(pdf["x"].to_numpy())
        rows, d = nearest(x, x, min_samples, True)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[rows], "block": pdf["block"].iloc[0], "d": d})

    first = staged(blocks.points.groupBy("block").applyInPandas(inside, f"id {id_type}, block int, d double"))
    # A point of a small block may know fewer distances: it has no bound yet.
    known = first.groupBy("block", "id").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    bound = F.when(F.col("n") == min_samples, F.col("d"))
    known = known.select(F.col("block").alias("_block"), F.col("id").alias("_id"), bound.alias("_bound"))
    mine = (F.col("block") == F.col("_block")) & (F.col("id") == F.col("_id"))
    bounded = blocks.points.join(known, mine, "left").select(
        *blocks.points.columns, F.coalesce("_bound", F.lit(float("inf"))).alias("bound")
    )
    bounded = staged(bounded)
    reach = reach_of_blocks(blocks, bounded.groupBy("block").agg(F.max("bound").alias("d")))

    def between(left, right, same):
        import numpy as np
        import pandas as pd

        a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        out = []
        for side, mine, others in [(left, a, b), (right, b, a)]:
            ids = side["id"].to_numpy()
            rows, d = nearest_within(mine, others, min_samples, side["bound"].to_numpy())
            out.append(pd.DataFrame({"id": ids[rows], "d": d}))
        return pd.concat(out)

    more = over_meeting_blocks(blocks, bounded, reach, between, f"id {id_type}, d double")
    closest = head_per_group(first.select("id", "d").union(more), ["id"], ["d"], min_samples)
    kth = F.max(F.when(F.col("rn") == min_samples, F.col("d")))
    return closest.groupBy("id").agg(kth.alias("core_distance")).withColumnRenamed("id", id_col)


def dense_points(
    arrays: DataFrame, eps: float, min_samples: int, count: int, block_rows: int | None
) -> DataFrame:
    """The points with at least ``min_samples`` others within ``eps``; cells return counts."""
    id_type = arrays.schema["id"].dataType.simpleString()

    def kernel(left, right, same):
        import numpy as np
        import pandas as pd

        a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        n_left, n_right = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        for start, near in near_strips(a, b, eps):
            if same:
                near[np.arange(len(near)), np.arange(start, start + len(near))] = False
            n_left[start : start + len(near)] = near.sum(axis=1)
            n_right += near.sum(axis=0)
        frames = [pd.DataFrame({"id": left["id"], "near": n_left})]
        if not same:
            frames.append(pd.DataFrame({"id": right["id"], "near": n_right}))
        return pd.concat(frames)

    near = over_block_pairs(arrays, count, kernel, f"id {id_type}, near bigint", block_rows)
    dense = near.groupBy("id").agg(F.sum("near").alias("near")).where(F.col("near") >= min_samples)
    return arrays.join(dense.select("id"), "id", "left_semi")


def _cell_links(dense: DataFrame, eps: float, count: int, block_rows: int | None) -> DataFrame:
    """(u, v) links that connect what lies within ``eps``. A cell joins its own points first
    and returns one link per point, not one per close pair."""
    id_type = dense.schema["id"].dataType.simpleString()

    def kernel(left, right, same):
        import numpy as np
        import pandas as pd

        a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        near = np.concatenate([flags for _, flags in near_strips(a, b, eps)])
        n, m = near.shape
        if same:
            # Smallest reachable position, spread until nothing changes.
            label = np.arange(n)
            while True:
                best = np.where(near, label[None, :], n).min(axis=1)
                new = np.minimum(label, best)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            ids = left["id"].to_numpy()
            return pd.DataFrame({"u": ids, "v": ids[label]})
        # The same across two blocks; jumping to the label of a label makes the rounds of a
        # long chain few.
        label = np.arange(n + m)
        while True:
            to_b = np.minimum(label[n:], np.where(near, label[:n, None], n + m).min(axis=0))
            to_a = np.minimum(label[:n], np.where(near, to_b[None, :], n + m).min(axis=1))
            new = np.concatenate([to_a, to_b])
            new = new[new]
            if (new == label).all():
                break
            label = new
        ids = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()])
        told = (np.arange(n + m) < n) | (label < n)
        return pd.DataFrame({"u": ids[told], "v": ids[label[told]]})

    # The kernel keeps a whole cell of flags, so its blocks stay small.
    rows = block_rows or BLOCK_ROWS
    return over_block_pairs(dense, count, kernel, f"u {id_type}, v {id_type}", rows)


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id each point can reach.

    Alternates two star contractions, each a group-by and a join: every neighbour larger
    than a point moves to the smallest point around it, then every smaller one does. The
    links shrink to one star per component in a logarithmic number of rounds; each round
    ends in a checkpoint, so a lost executor does not restart the loop.
    """
    edges = cut_lineage(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    nodes = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        # All links now point from a larger to a smaller id.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = cut_lineage(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.withColumnRenamed("u", "id"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component")
    )


def number_in_order(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of a column: sorted ranges, each numbered on its
    own, plus the size of the ranges before it (one row per partition)."""
    ranges = rows.repartitionByRange(column).sortWithinPartitions(column)
    # Fixed value: Spark puts the partition number above bit 33 of this id.
    placed = cut_lineage(ranges.withColumn("_at", F.monotonically_increasing_id()))
    part, offset = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*rows.columns, (F.col("_start") + offset).cast("int").alias(name))
    )


def density_cluster(
    points: DataFrame,
    eps: float,
    min_cluster_size: int = 10,
    min_samples: int = 5,
    id_col: str = "userid",
    block_rows: int | None = None,
) -> DataFrame:
    """(id, cluster) at radius ``eps``. Clusters are numbered from 0 by their smallest id."""
    arrays = point_arrays(points.select(id_col, "features"), id_col)
    count = arrays.count()
    dense = cut_lineage(dense_points(arrays, eps, min_samples, count, block_rows))
    components = cut_lineage(connected_components(_cell_links(dense, eps, count, block_rows)))
    kept = (
        components.groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") >= min_cluster_size)
    )
    numbered = number_in_order(kept.select("component"), "component", "cluster")
    found = components.join(numbered, "component").select(F.col("id").alias(id_col), "cluster")
    return points.select(id_col).join(found, id_col, "left").select(
        id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )
