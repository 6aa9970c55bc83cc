"""Blocks around pivots, and distances at their edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from playcohort.operators.density import dense_points, neighbour_distances
from playcohort.operators.pairwise import meeting_blocks, near_strips, nearest, nearest_within, pivot_blocks, point_arrays


def far_groups(spark, shift=0.0):
    """Twelve groups of points, each far from all others."""
    return spark.range(600).selectExpr(
        "id AS userid",
        f"array(id % 12 * 1000 + sin(id) + {shift}D, cos(id * 3) - {shift}D, sin(id * 7)) AS features",
    )


def test_far_blocks_never_meet(spark):
    arrays = point_arrays(far_groups(spark), "userid")
    blocks = pivot_blocks(arrays, 600, 10)
    assert {r.n for r in blocks.points.groupBy("block").agg(F.count("*").alias("n")).collect()} <= set(range(1, 31))
    reach = np.full(len(blocks.radii), 2.0)
    pairs = [(b, int(o)) for b in range(len(reach)) for o in meeting_blocks(blocks.centres, blocks.radii, reach, b)]
    group = np.round(blocks.centres[:, 0] / 1000)
    close = [(a, b) for a, b in pairs if group[a] == group[b]]
    # A block whose points span groups has a large radius; all others stay in their group.
    wide = {k for k in range(len(reach)) if blocks.radii[k] > 100}
    assert all(group[a] == group[b] or a in wide or b in wide for a, b in pairs)
    assert len(close) < len(pairs) + 1 and len(pairs) < len(reach) * (len(reach) - 1) / 4


def test_core_distances_for_any_block_size_and_place(spark):
    rows = far_groups(spark).collect()
    x = np.array([r.features for r in rows])
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {r.userid: d for r, d in zip(rows, np.sort(full, axis=1)[:, 5])}
    for block_rows in (None, 300, 9):
        got = {r.userid: r.core_distance for r in neighbour_distances(far_groups(spark), 5, block_rows=block_rows).collect()}
        assert got == pytest.approx(want, rel=1e-12)
    moved = far_groups(spark, 1e6)
    got = {r.userid: r.core_distance for r in neighbour_distances(moved, 5, block_rows=40).collect()}
    assert got == pytest.approx(want, rel=1e-8)
    assert all(r[1] is None for r in neighbour_distances(moved.limit(5), 5).collect())


def test_a_radius_that_is_a_core_distance(spark):
    """With the k-th distance of a point as radius, the point has k others within it."""
    arrays = point_arrays(far_groups(spark, 1e4), "userid")
    core = {r.userid: r.core_distance for r in neighbour_distances(far_groups(spark, 1e4), 5, block_rows=50).collect()}
    for userid in (3, 77, 400):
        dense = {r.id for r in dense_points(arrays, core[userid], 5, 600, 70).collect()}
        assert dense == {u for u, d in core.items() if d <= core[userid]} and userid in dense


def test_kernels_against_plain_distances():
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(size=(300, 3)), 1) + 1e5
    b = np.concatenate([a[:50], np.round(rng.normal(size=(200, 3)), 1) + 1e5])
    full = np.array([[math.dist(p, q) for q in b] for p in a])
    rows, d = nearest(a, b, 4, False)
    assert np.allclose(d.reshape(300, 4), np.sort(full, axis=1)[:, :4], rtol=1e-14, atol=0)
    assert (np.bincount(rows) == 4).all()
    eps = float(np.sort(full[0])[7])
    flags = np.concatenate([near for _, near in near_strips(a, b, eps)])
    direct = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)) <= eps
    assert (flags == direct).all()


def test_candidates_beyond_the_bound_of_a_point_are_not_passed_on():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 4)) + 100, rng.normal(size=(70, 4)) + 100
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    bound = np.sort(d, axis=1)[:, 2]
    bound[::5], bound[1::5] = np.inf, 0.0
    rows, found = nearest_within(a, b, 6, bound)
    for k in range(len(a)):
        want = np.sort(d[k])[:6]
        assert np.allclose(sorted(found[rows == k]), want[want <= bound[k]], rtol=1e-14, atol=0)
