"""Cluster quality.

A point's cluster is an int; -1 is noise and takes no part in any measure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from playcohort.functions.quantiles import exact_lower_share
from playcohort.operators.pairwise import (
    cell_shape,
    distance_strips,
    distance_tiles,
    over_block_pairs,
    over_meeting_blocks,
    over_rectangles,
    pivot_blocks,
    point_arrays,
    reach_of_blocks,
)
from playcohort.session import staged


def drop_noise(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("cluster") != -1)


def as_vectors(points: DataFrame) -> DataFrame:
    """``features`` as an MLlib vector, from an array or a vector."""
    if isinstance(points.schema["features"].dataType, T.ArrayType):
        return points.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    return points


#: Labelled clusters up to which a point keeps a sum for every one.
DENSE_SLOTS = 1024
#: Rows and columns of a tile of distances, which stays in the cache of a core.
TILE = 128, 1024
#: Points whose sums are finished together.
FINISH_ROWS = 2048
#: Numbers in a strip of the table of differences between cluster centres.
_CENTRE_CELLS = 1 << 22


# -- silhouette -----------------------------------------------------------------------


def _silhouettes(points: DataFrame, labellings: int, block_rows: int | None) -> DataFrame:
    """(labelling, id, cluster, s): exact Euclidean silhouette of each point in each of
    several labellings. ``points`` has id, x and ``labs``, the cluster of the point in each
    labelling or null where it takes no part.

    One pass over the block pairs serves all labellings. Up to ``DENSE_SLOTS`` labelled clusters
    the kernel multiplies distances with cluster indicators, and a point gets one sum for each;
    beyond, it gets sums of the clusters that can be its own or its nearest other one only.
    """
    sizes_df = (
        points.select(F.posexplode("labs").alias("labelling", "cluster"))
        .where(F.col("cluster").isNotNull())
        .groupBy("labelling", "cluster")
        .agg(F.count(F.lit(1)).alias("size"))
    )
    some = sizes_df.limit(DENSE_SLOTS + 1).count()
    ab = _sparse_means(points, staged(sizes_df), block_rows) if some > DENSE_SLOTS else _dense_means(points, sizes_df, block_rows)
    # A point alone in its cluster scores 0; so does everything while there is one cluster.
    s = F.coalesce(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)
    )
    return ab.select("labelling", "id", "cluster", s.alias("s"))


def _dense_means(points: DataFrame, sizes_df: DataFrame, block_rows: int | None) -> DataFrame:
    """(labelling, id, cluster, a, b): mean distance to the own cluster and to the nearest other.

    A cell adds up the distances of a block of points to a block or chunk of points, one sum for each
    labelled cluster; the sums of a point meet in small groups and are finished
    there, so what is shuffled is a row per point and cell and the sums per point and chunk.
    Two blocks add up for each other, so a distance is worked out once (see ``cell_shape``).
    """
    # At most DENSE_SLOTS rows.
    sizes = sizes_df.orderBy("labelling", "cluster").collect()
    width = len(sizes)
    at = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max(F.size("labs")).alias("labellings")).first()
    depth, labellings = at["d"] or 0, at["labellings"] or 0
    blocks, chunks = cell_shape(at["n"], depth + labellings, width, block_rows)
    of_labelling = [[i for i, r in enumerate(sizes) if r["labelling"] == k] for k in range(labellings)]
    clusters = np.array([r["cluster"] for r in sizes], dtype=float)
    labelling_of = np.array([r["labelling"] for r in sizes], dtype=np.int64)
    counts = np.array([r["size"] for r in sizes], dtype=float)
    spec = points.schema["id"].dataType.simpleString()
    buckets = max(1, -(-at["n"] // FINISH_ROWS))

    def members(labs, slots=slice(None)):
        """Which clusters, of those in ``slots``, each row of labels is in."""
        # A null label, where the point takes no part, is NaN and equals no cluster.
        return (labs[:, labelling_of[slots]] == clusters[None, slots]).astype(float)

    class Side:
        """Points in an order in which those of a run have the same labels (``table``: the clusters
        of each run), or are in the same cluster wherever they take part (``parts``: its slots)."""

        def __init__(self, frame):
            self.ids, self.labs = frame["id"].to_numpy(), np.stack(frame["labs"].to_numpy()).astype(float)
            self.order, self.runs, self.parts = _runs(self.labs)
            self.x = np.stack(frame["x"].to_numpy())[self.order]
            self.place = np.empty(len(self.order), dtype=np.int64)
            self.place[self.order] = np.arange(len(self.order))
            self.table = members(self.labs[self.order[self.runs]]) if self.parts is None else None
            self.sums = np.zeros((len(self.order), width))

        def met(self, where):
            """Runs that reach into the slice ``where``, and where they begin in it."""
            first = np.searchsorted(self.runs, where.start, side="right") - 1
            last = np.searchsorted(self.runs, where.stop)
            return first, last, np.maximum(self.runs[first:last] - where.start, 0)

        def add(self, where, other, there, dist):
            """Add the distances of the rows ``where`` to the rows ``there`` of the other side."""
            first, last, edges = other.met(there)
            if other.parts is None:
                if dist.flags.c_contiguous:
                    by_run = np.add.reduceat(dist, edges, axis=1)
                else:
                    lengths = np.diff(edges, append=there.stop - there.start)
                    by_run = (np.repeat(np.eye(last - first), lengths, axis=1) @ dist.T).T
                self.sums[where] += by_run @ other.table[first:last]
                return
            for k, low, high in zip(range(first, last), edges, [*edges[1:], there.stop - there.start]):
                labs = other.labs[other.order[there.start + low : there.start + high]]
                self.sums[where, other.parts[k]] += dist[:, low:high] @ members(labs, other.parts[k])

        def named(self, chunk, known):
            """Rows of the result; labels are told by the cell of a point and itself."""
            import pandas as pd

            labs = list(self.labs) if known else None
            return pd.DataFrame({"chunk": chunk, "id": self.ids, "labs": labs, "sums": list(self.sums[self.place])})

    def kernel(rows, columns, own, other):
        import pandas as pd

        a, b = Side(rows), Side(columns)
        both = own is None and chunks is None
        # Which columns the rows are, in the order of both.
        own = None if own is None else b.place[own][a.order]
        for at_rows, at_columns, dist in distance_tiles(a.x, b.x, *TILE):
            start, stop = at_columns.start, at_columns.stop
            if own is not None:
                inside = np.flatnonzero((own[at_rows] >= start) & (own[at_rows] < stop))
                dist[inside, own[at_rows][inside] - start] = 0.0
            a.add(at_rows, b, at_columns, dist)
            if both:
                b.add(at_columns, a, at_rows, dist.T)
        told = a.named(other if chunks is not None else other[0], own is not None)
        return pd.concat([told, b.named(other[1], False)], ignore_index=True) if both else told

    def _runs(labs):
        """An order of the columns, where its runs start, and for each run the slots that its rows
        are members of (None, if the rows of a run have the same labels)."""
        known = np.nan_to_num(labs, nan=-np.inf)
        order = np.lexsort(known.T[::-1])
        change = np.flatnonzero((known[order][1:] != known[order][:-1]).any(axis=1)) + 1
        if 16 * len(change) <= len(order):
            return order, np.concatenate([[0], change]), None
        # Sub-samples of one labelling: a point is in its one cluster, wherever it takes part.
        largest = known.max(axis=1)
        order = np.argsort(largest, kind="stable")
        runs = np.concatenate([[0], np.flatnonzero(np.diff(largest[order])) + 1])
        ends = [*runs[1:], len(order)]
        parts = [_slice(np.flatnonzero(_any_member(labs[order[a:b]]))) for a, b in zip(runs, ends)]
        return order, runs, parts

    def _any_member(labs):
        found = np.zeros(width, dtype=bool)
        for start in range(0, len(labs), FINISH_ROWS):
            found |= members(labs[start : start + FINISH_ROWS]).any(axis=0)
        return found

    def _slice(slots):
        step = slots[1] - slots[0] if len(slots) > 1 else 1
        regular = len(slots) and step > 0 and (np.diff(slots) == step).all()
        return slice(int(slots[0]), int(slots[-1]) + 1, int(step)) if regular else slots

    def finish(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = table["id"].combine_chunks().dictionary_encode()
        codes = ids.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((table["chunk"].to_numpy(), codes))
        firsts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        sums = table["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(codes), width)
        total = np.add.reduceat(sums[order], firsts, axis=0)
        # The cell of a block and the chunk that holds it names the labels.
        named = pc.is_valid(table["labs"])
        rows = codes[named.to_numpy()]
        labs = table["labs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), labellings)
        out = []
        for k, slots in enumerate(of_labelling):
            here = ~np.isnan(labs[:, k])
            # Rows that share an id count as one point of each of their clusters.
            found = np.unique(np.stack([rows[here], labs[here, k].astype(np.int64)], axis=1), axis=0)
            if not len(found):
                continue
            point, cluster = found[:, 0], found[:, 1]
            mine = np.searchsorted(clusters[slots], cluster)
            sums = total[point][:, slots]
            own, size = sums[np.arange(len(point)), mine], counts[slots][mine]
            means = sums / counts[None, slots]
            means[np.arange(len(point)), mine] = np.inf
            nearest = means.min(axis=1)
            out.append(
                pa.table(
                    {
                        "labelling": pa.array(np.full(len(point), k), pa.int32()),
                        "id": ids.dictionary.take(pa.array(point)),
                        "cluster": pa.array(cluster, pa.int32()),
                        "a": pa.array(own / np.maximum(size - 1, 1), mask=size <= 1),
                        "b": pa.array(nearest, mask=np.full(len(point), len(slots) < 2)),
                    }
                )
            )
        return pa.concat_tables(out)

    partial = over_rectangles(
        points.select("id", "x", "labs"), blocks, chunks, kernel, f"chunk int, id {spec}, labs array<double>, sums array<double>"
    )
    bucket = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(buckets)).alias("bucket")
    return (
        partial.where(F.col("id").isNotNull())
        .select("chunk", "id", "labs", "sums", bucket)
        .groupBy("bucket")
        .applyInArrow(finish, f"labelling int, id {spec}, cluster int, a double, b double")
    )


def _sparse_means(points: DataFrame, sizes: DataFrame, block_rows: int | None) -> DataFrame:
    """The same for many clusters.

    The mean distance of a point to a cluster is no less than that to its centre, and no more
    than that plus the mean distance of its members to the centre. Within blocks of points
    that lie together each point finds a first bound from the clusters it meets there; in the
    other blocks only clusters whose centre is nearer than that, and its own, are summed. A
    task holds a strip of distances and of sums, whatever the number of clusters.
    """
    long = points.select("id", "x", F.posexplode("labs").alias("labelling", "cluster")).where(F.col("cluster").isNotNull())
    keys = ["labelling", "cluster"]
    mean = vector_to_array(Summarizer.mean(array_to_vector("x")))
    centres = staged(long.groupBy(*keys).agg(mean.alias("centre")))
    with_centre = long.join(centres, keys)
    spread = with_centre.groupBy(*keys).agg(F.avg(_distance_to(F.col("centre"), F.col("x"))).alias("spread"))
    known = centres.join(spread, keys)
    # A labelling is a set of points of its own; names tell them apart in the blocks.
    rows = staged(long.join(known, keys).select(F.struct("labelling", "id").alias("id"), "x", "labelling", "cluster", "centre", "spread"))
    blocks = pivot_blocks(rows, rows.count(), block_rows)
    key_type = rows.schema["id"].dataType.simpleString()

    def met(frame):
        """The clusters of a block: for each (labelling, cluster) its number, its centre and spread."""
        codes, firsts, of = np.unique(
            np.stack([frame["labelling"], frame["cluster"]], axis=1), axis=0, return_index=True, return_inverse=True
        )
        first = frame.iloc[firsts]
        return codes, of.ravel(), np.stack(first["centre"].to_numpy()), first["spread"].to_numpy()

    def bounds(pdf):
        x = np.stack(pdf["x"].to_numpy())
        codes, of, middle, wide = met(pdf)
        labelling = pdf["labelling"].to_numpy()
        bound = np.full(len(x), np.inf)
        for start in range(0, len(codes), 256):
            part = slice(start, start + 256)
            far = np.sqrt(((x[:, None, :] - middle[None, part, :]) ** 2).sum(axis=2)) + wide[None, part]
            other = (codes[None, part, 0] == labelling[:, None]) & (np.arange(len(codes))[None, part] != of[:, None])
            bound = np.minimum(bound, np.where(other, far, np.inf).min(axis=1))
        return pdf.assign(bound=bound)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.points.schema.fields)
    bounded = staged(blocks.points.groupBy("block").applyInPandas(bounds, f"{kind}, bound double"))

    def sums(left, right, same):
        import pandas as pd

        out = []
        for one, two in [(left, right)] if same else [(left, right), (right, left)]:
            x, y = np.stack(one["x"].to_numpy()), np.stack(two["x"].to_numpy())
            codes, of, middle, _ = met(two)
            own = one[["labelling", "cluster"]].to_numpy()
            bound, ids = one["bound"].to_numpy() * (1 + 1e-9), one["id"].to_numpy()
            order = np.argsort(of, kind="stable")
            firsts = np.searchsorted(of[order], np.arange(len(codes)))
            for start, dist in distance_strips(x, y[order], cells=1 << 20):
                stop = start + len(dist)
                if same:
                    at = np.empty(len(order), dtype=np.int64)
                    at[order] = np.arange(len(order))
                    dist[np.arange(len(dist)), at[start:stop]] = 0.0
                total = np.add.reduceat(dist, firsts, axis=1)
                near = next(distance_strips(x[start:stop], middle, cells=1 << 62))[1] <= bound[start:stop, None]
                labelling = codes[None, :, 0] == own[start:stop, None, 0]
                mine = labelling & (codes[None, :, 1] == own[start:stop, None, 1])
                rows_, columns = np.nonzero(labelling & (near | mine))
                out.append(
                    pd.DataFrame({"id": ids[start:stop][rows_], "to": codes[columns, 1], "total": total[rows_, columns]})
                )
        return pd.concat(out)

    names = over_block_pairs(bounded, bounded.count(), sums, f"id {key_type}, to int, total double", block_rows)
    added = names.groupBy("id", "to").agg(F.sum("total").alias("total"))
    sized = added.select("id.id", "id.labelling", "to", "total").join(
        sizes.withColumnRenamed("cluster", "to"), ["labelling", "to"]
    )
    mine = F.col("to") == F.col("cluster")
    return (
        sized.join(long.select("id", "labelling", "cluster"), ["id", "labelling"])
        .groupBy("labelling", "id", "cluster")
        .agg(
            F.max(F.when(mine & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
            F.min(F.when(~mine, F.col("total") / F.col("size"))).alias("b"),
        )
    )


def silhouette_samples(
    points: DataFrame, id_col: str = "userid", block_rows: int | None = None
) -> DataFrame:
    """(id, cluster, silhouette) of every point that is not noise."""
    arrays = point_arrays(drop_noise(points), id_col)
    # Sizes, count, blocks and own labels are read from it.
    arrays = staged(arrays.select("id", "x", F.array(F.col("cluster").cast("int")).alias("labs")))
    out = _silhouettes(arrays, 1, block_rows)
    return out.select(F.col("id").alias(id_col), "cluster", F.col("s").alias("silhouette"))


def silhouette_exact(
    points: DataFrame, id_col: str = "userid", block_rows: int | None = None
) -> DataFrame:
    """One row: the mean exact Euclidean silhouette (0 with fewer than two clusters)."""
    samples = silhouette_samples(points, id_col, block_rows)
    return samples.agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))


def silhouette_by_labelling(
    points: DataFrame, id_col: str = "userid", block_rows: int | None = None
) -> dict[int, float]:
    """Mean exact silhouette for each position of an array column ``labs`` of cluster ids."""
    arrays = staged(point_arrays(points, id_col))
    n = len(arrays.select("labs").first()["labs"])
    rows = _silhouettes(arrays, n, block_rows).groupBy("labelling").agg(F.avg("s").alias("s"))
    return {r["labelling"]: r["s"] for r in rows.collect()}


def silhouette_squared(points: DataFrame) -> float:
    """MLlib's linear-cost silhouette with squared distances: a different number, for callers
    who ask for it because quadratic work is out of reach."""
    kept = as_vectors(drop_noise(points)).select("features", F.col("cluster").cast("int"))
    return ClusteringEvaluator(predictionCol="cluster", distanceMeasure="squaredEuclidean").evaluate(kept)


def check_silhouette(kind: str) -> None:
    if kind not in ("exact", "squared"):
        raise ValueError(f"the silhouette is 'exact' or 'squared', not {kind!r}")


def subsample_memberships(
    points: DataFrame, replicates: int, share: float, id_col: str = "userid"
) -> DataFrame:
    """(replicate, id, cluster): in each replicate exactly ``int(n * share)`` points, those
    with the smallest hash of id and replicate number. Nothing is ranked in one task: the
    limiting hash of each replicate is an exact order statistic."""
    tickets = points.select(
        id_col, "cluster", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    )
    digest = F.md5(F.concat_ws("_", F.col(id_col).cast("string"), F.col("replicate").cast("string")))
    # 13 hex digits fit a double exactly.
    ticket = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    tickets = tickets.withColumn("ticket", ticket)
    limit = exact_lower_share(tickets, ["replicate"], "ticket", share, "last_ticket")
    return (
        tickets.join(F.broadcast(limit), "replicate")  # one row per replicate
        .where(F.col("ticket") <= F.col("last_ticket"))
        .select("replicate", id_col, "cluster")
    )


def silhouette_replicates(
    points: DataFrame,
    replicates: int = 50,
    share: float = 0.8,
    id_col: str = "userid",
    block_rows: int | None = None,
) -> DataFrame:
    """(replicate, silhouette) over sub-samples without replacement; replicates with fewer
    than two clusters are left out."""
    kept = drop_noise(points)
    chosen = subsample_memberships(kept.select(id_col, "cluster"), replicates, share, id_col)
    labs = chosen.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("replicate", "cluster"))).alias("by_replicate")
    )
    arrays = point_arrays(kept.select(id_col, "features").join(labs, id_col), id_col)
    every = F.transform(
        F.sequence(F.lit(1), F.lit(replicates)),
        lambda r: F.try_element_at(F.col("by_replicate"), r).cast("int"),
    )
    chosen_in = staged(arrays.select("id", "x", every.alias("labs")))
    scored = _silhouettes(chosen_in, replicates, block_rows)
    return (
        scored.groupBy("labelling")
        .agg(F.avg("s").alias("silhouette"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .select((F.col("labelling") + 1).alias("replicate"), "silhouette")
    )


def silhouette_stability(
    points: DataFrame,
    replicates: int = 50,
    share: float = 0.8,
    id_col: str = "userid",
    block_rows: int | None = None,
) -> DataFrame:
    """One row: mean and population deviation of the replicate silhouettes."""
    return silhouette_replicates(points, replicates, share, id_col, block_rows).agg(
        F.avg("silhouette").alias("mean_silhouette"),
        F.stddev_pop("silhouette").alias("std_silhouette"),
    )


# -- centroid based measures ----------------------------------------------------------


@dataclass(frozen=True)
class Centroids:
    """Per cluster: size, centre and squared distance to it. Clusters x columns numbers."""

    cluster: list[int]
    size: np.ndarray
    centre: np.ndarray
    within: np.ndarray

    @property
    def rows(self) -> int:
        return int(self.size.sum())

    @property
    def inertia(self) -> float:
        return float(self.within.sum())

    @property
    def between(self) -> float:
        middle = (self.size[:, None] * self.centre).sum(axis=0) / self.size.sum()
        return float((self.size * ((self.centre - middle) ** 2).sum(axis=1)).sum())


def fit_centroids(points: DataFrame) -> Centroids:
    """One pass with MLlib's vector summary per cluster, combined per task."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(F.col("features"))
    rows = (
        as_vectors(drop_noise(points))
        .groupBy("cluster")
        .agg(summary.alias("s"))
        .select("cluster", "s.mean", "s.variance", "s.count")
        .orderBy("cluster")
        .collect()
    )
    size = np.array([r["count"] for r in rows], dtype=float)
    variance = np.array([r["variance"].toArray().sum() for r in rows])
    return Centroids(
        [r["cluster"] for r in rows],
        size,
        np.array([r["mean"].toArray() for r in rows]),
        variance * np.maximum(size - 1, 0),
    )


def inertia(points: DataFrame) -> float:
    """Squared distance of the points to the centre of their cluster."""
    return fit_centroids(points).inertia


def calinski_harabasz(points: DataFrame, centroids: Centroids | None = None) -> float:
    c = centroids or fit_centroids(points)
    k = len(c.cluster)
    if k < 2:
        return 0.0
    if c.inertia == 0.0:
        return 1.0
    return (c.between / (k - 1)) / (c.inertia / (c.rows - k))


def _distance_to(centre: Column, x: Column) -> Column:
    squares = F.zip_with(x, centre, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def _worst_partners(left, right, same):
    """The largest (S_i + S_j) / M_ij of each cluster of both sides with one of the other; centres
    that coincide are passed over."""
    import pandas as pd

    a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
    sa, sb = left["s"].to_numpy(), right["s"].to_numpy()
    for_a, for_b = np.zeros(len(a)), np.zeros(len(b))
    strip = max(1, _CENTRE_CELLS // max(1, len(b) * b.shape[1]))
    for start in range(0, len(a), strip):
        part = slice(start, start + strip)
        m = np.sqrt(((a[part, None, :] - b[None, :, :]) ** 2).sum(axis=2))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (sa[part, None] + sb[None, :]) / m
        r[~np.isfinite(r)] = 0.0
        if same:
            r[np.arange(len(r)), np.arange(start, start + len(r))] = 0.0
        for_a[part] = r.max(axis=1)
        for_b = np.maximum(for_b, r.max(axis=0))
    sides = [pd.DataFrame({"id": left["id"], "worst": for_a})]
    if not same:
        sides.append(pd.DataFrame({"id": right["id"], "worst": for_b}))
    return pd.concat(sides)


def davies_bouldin(
    points: DataFrame, centroids: Centroids | None = None, block_rows: int | None = None
) -> float:
    """Mean over clusters of the worst (S_i + S_j) / M_ij.

    The spread S needs a second pass over the points. Centres are dealt into blocks around
    pivots. Each cluster first finds its worst partner inside its block; two blocks meet only
    if they are near enough for a pair with the largest spreads to be worse than that.
    """
    spark = points.sparkSession
    kept = drop_noise(points).withColumn("cluster", F.col("cluster").cast("int"))
    if centroids is not None:
        rows = [(int(i), [float(v) for v in m]) for i, m in zip(centroids.cluster, centroids.centre)]
        table = spark.createDataFrame(rows, "id int, x array<double>")
    else:
        mean = Summarizer.mean(F.col("features"))
        means = as_vectors(kept).groupBy("cluster").agg(mean.alias("m"))
        table = staged(means.select(F.col("cluster").alias("id"), vector_to_array("m").alias("x")))
    k = table.count()
    if k < 2:
        return 0.0
    arrays = kept.withColumn(
        "_x",
        F.col("features").cast("array<double>")
        if isinstance(points.schema["features"].dataType, T.ArrayType)
        else vector_to_array("features"),
    )
    spread = (
        arrays.select("cluster", "_x")
        .join(table, F.col("cluster") == F.col("id"))
        .groupBy("cluster")
        .agg(F.avg(_distance_to(F.col("x"), F.col("_x"))).alias("s"))
    )
    centres = staged(table.join(spread, F.col("id") == F.col("cluster")).drop("cluster"))
    blocks = pivot_blocks(centres, k, block_rows)

    def inside(pdf):
        return _worst_partners(pdf, pdf, True).assign(block=int(pdf["block"].iloc[0]))

    own = staged(blocks.points.groupBy("block").applyInPandas(inside, "id int, worst double, block int"))
    least = own.groupBy("block").agg(F.min("worst").alias("worst"))
    widest = blocks.points.groupBy("block").agg(F.max("s").alias("s"))
    largest = F.max("s").over(Window.partitionBy())
    # One row per block.
    bound = widest.join(least, "block").withColumn("all", largest)
    reach = F.when(F.col("worst") > 0, (F.col("s") + F.col("all")) / F.col("worst")).otherwise(F.lit(float("inf")))
    far = reach_of_blocks(blocks, bound.select("block", reach.alias("d")))
    met = over_meeting_blocks(blocks, blocks.points, far, _worst_partners, "id int, worst double")
    worst = own.select("id", "worst").union(met).groupBy("id").agg(F.max("worst").alias("worst"))
    return float(worst.agg(F.avg("worst")).first()[0])


def quality_row(spark: SparkSession, **values: float) -> DataFrame:
    """Measures as a one-row table."""
    names = list(values)
    return spark.createDataFrame(
        [tuple(float(values[n]) for n in names)], ", ".join(f"{n} double" for n in names)
    )


def elbow_table(
    spark: SparkSession, inertias: dict[int, float], silhouettes: dict[int, float]
) -> DataFrame:
    """(k, inertia, silhouette), one row per swept k, sorted by k."""
    rows = [(k, float(inertias[k]), silhouettes.get(k)) for k in sorted(inertias)]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")
