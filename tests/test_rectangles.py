"""Sums over all points in large cells, and forests whose drawn rows are not stored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playcohort.operators import importance, profiles, quality
from playcohort.operators.pairwise import distance_tiles, rectangle_counts


def brute(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = np.zeros(len(x))
    for i in np.flatnonzero(~np.isnan(lab)):
        means = {c: d[i, lab == c].sum() / max(1, (lab == c).sum() - (c == lab[i])) for c in set(lab[~np.isnan(lab)])}
        a, b = means.pop(lab[i]), min(means.values())
        out[i] = (b - a) / max(a, b) if (lab == lab[i]).sum() > 1 else 0.0
    return out


@pytest.mark.parametrize("block_rows", [None, 37])
def test_sums_of_labellings_and_of_subsamples(spark, block_rows):
    """Both ways of adding up: runs of equal labels, and members of one labelling that come and go."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) + 50
    x[7] = x[8]
    few = np.stack([np.arange(200) % 2, np.arange(200) % 5]).T.astype(float)
    many = np.where(rng.random((200, 9)) < 0.6, (np.arange(200) % 3)[:, None], np.nan)
    many[:, 4] = np.where(np.arange(200) == 5, 0, many[:, 4] * 0 + 1)
    for labs in (few, many):
        rows = [(f"u{i}", [float(v) for v in x[i]], [None if np.isnan(v) else int(v) for v in labs[i]]) for i in range(200)]
        points = spark.createDataFrame(rows, "id string, x array<double>, labs array<int>")
        got = quality._silhouettes(points, labs.shape[1], block_rows).collect()
        assert len(got) == (~np.isnan(labs)).sum()
        want = [brute(x, labs[:, k]) for k in range(labs.shape[1])]
        for r in got:
            assert r["s"] == pytest.approx(want[r["labelling"]][int(r["id"][1:])], abs=1e-9)


def test_points_are_sent_to_few_cells():
    """Not to one cell per 4,096 points, while a cell stays within its bytes."""
    for count, rows, columns in ((90_000, 77, 33), (900_000, 77, 33), (720_000, 564, 114), (20_000_000, 77, 33)):
        blocks, chunks = rectangle_counts(count, rows, columns)
        assert blocks % chunks == 0
        assert count / blocks * rows * 8 < 100 << 20 and count / chunks * columns * 8 < 130 << 20
        assert blocks * chunks >= 64
        if count < 1_000_000:
            assert blocks + chunks < 50
    assert rectangle_counts(10, 77, 33) == (1, 1)


def test_tiles_cover_the_table():
    a, b = np.random.default_rng(0).normal(size=(2, 30, 4))
    out = np.full((30, 30), -1.0)
    for rows, columns, dist in distance_tiles(a, b, 7, 11):
        out[rows, columns] = dist
    assert out == pytest.approx(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)), abs=1e-7)


def test_drawn_rows_of_a_forest_are_not_stored(spark, monkeypatch):
    """A table of every tree's rows grows with trees times rows."""
    kept = []

    def staged(df):
        kept.append(set(df.columns))
        return df.localCheckpoint()

    monkeypatch.setattr(importance, "staged", staged)
    rows = spark.range(600).select(
        "id", F.array((F.col("id") * 7 % 101).cast("double"), (F.col("id") % 5).cast("double")).alias("x"),
        (F.col("id") * 31 % 3).cast("int").alias("label"),
    )
    trees = importance.grow_forest(rows, 2, 4, 1, 100).collect()
    assert len(trees) == 4 and not [c for c in kept if {"tree", "x"} <= c]
    whole = importance.grow_forest(rows, 2, 4, 1).collect()
    assert {r["tree"]: r["root"] for r in trees} == pytest.approx({r["tree"]: r["root"] for r in whole})


def test_shuffles_are_put_together_by_size(spark):
    """More parts than a fixed number gives, so that a task's share does not follow the table."""
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > 200
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_ages_are_kept_once_for_all_reads(spark, monkeypatch):
    kept = []

    def staged(df):
        kept.append(df.columns)
        return df.localCheckpoint()

    monkeypatch.setattr(profiles, "staged", staged)
    rows = spark.createDataFrame([("u1", "a", 1.0), ("u2", "a", 4.0), ("u3", "b", None)], "userid string, cluster_name string, age double")
    got = {r["cluster_name"]: r["median_age"] for r in profiles.median_age_by_cluster(rows).collect()}
    assert got == {"a": 2.5, "b": None} and kept == [["cluster_name", "age"]]


def test_distance_tiles_hold_no_copy_of_all_columns():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 40)), rng.normal(size=(40_000, 40))
    tracemalloc.start()
    for rows, columns, found in distance_tiles(a, b):
        if columns.start == 8192 and rows.start == 0:
            want = np.sqrt(((a[rows][:3, None] - b[columns][None]) ** 2).sum(axis=2))
            assert np.allclose(found[:3], want, rtol=1e-9, atol=1e-9)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # A strip of distances and some copies of a tile; two moved copies of all columns were 26 MB.
    assert peak < 2.0 * b.nbytes
