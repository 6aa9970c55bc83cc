"""Rounds of K-means over packed vectors, and silhouettes whose blocks add up for each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playcohort.operators import cluster, quality
from playcohort.operators.pairwise import cell_shape, over_rectangles


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_rows_are_added_up_at_their_first_nearest_centre(offset):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 3)) + offset
    centres = [x[:4], np.concatenate([x[:2], x[:2]])]
    sums, costs = [np.zeros((4, 4)) for _ in centres], np.zeros(2)
    for part in (x[:4500], x[4500:]):
        cluster.add_up(part, centres, sums, costs)
    for c, got, cost in zip(centres, sums, costs):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        assert got[:, 3].tolist() == np.bincount(at, minlength=4).tolist()
        assert got[:, :3] == pytest.approx(np.stack([x[at == k].sum(axis=0) for k in range(4)]), rel=1e-9)
        assert cost == pytest.approx(d.min(axis=1).sum(), rel=1e-9)


def test_a_far_centre_takes_no_digits_of_the_others():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    centres = np.concatenate([x[:1], x[:1] + 1e-7, np.full((1, 2), 1e6)])
    sums, costs = [np.zeros((3, 3))], np.zeros(1)
    cluster.add_up(x, [centres], sums, costs)
    at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert sums[0][:, 2].tolist() == np.bincount(at, minlength=3).tolist()


def test_rounds_read_blocks_of_vectors(spark):
    rows = spark.range(0, 9000, 1, 3).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    blocks = [np.frombuffer(r["x"]).reshape(-1, 2) for r in cluster.packed(rows, 18_000).collect()]
    assert 3 <= len(blocks) < 90 and max(map(len, blocks)) <= cluster.PACKED_ROWS
    assert sorted(np.concatenate(blocks)[:, 0]) == list(range(9000))
    models = {0: cluster.Model(np.array([[0.0, 1.0], [9000.0, 1.0]]))}
    assert cluster.advance(rows, models, 1e-9) == models[0].rounds
    assert sum(models[0].sizes) == 9000 and min(models[0].sizes) > 4400


def test_two_blocks_meet_once_unless_points_have_many_sums(spark):
    assert cell_shape(900_000, 26, 52)[1] is None and cell_shape(10, 26, 52) == (1, None)
    assert cell_shape(720_000, 114, 500)[1] is not None

    def kernel(rows, columns, own, other):
        import pandas as pd

        return pd.DataFrame({"i": [other[1]], "j": [other[0]], "n": [len(rows) * len(columns)]})

    points = spark.range(300).select("id", F.array(F.col("id").cast("double")).alias("x"))
    met = over_rectangles(points, 5, None, kernel, "i int, j int, n bigint").collect()
    assert sorted((r.i, r.j) for r in met) == [(i, j) for i in range(5) for j in range(i, 5)]
    assert sum(r.n * (1 if r.i == r.j else 2) for r in met) == 300 * 300


def test_sums_of_both_shapes_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 3)), np.ones((10, 3))])
    rows = [(f"u{i}", [float(v) for v in x[i]], [i % 2, None if i % 7 == 0 else i % 5]) for i in range(160)]
    points = spark.createDataFrame(rows, "id string, x array<double>, labs array<int>")
    found = []
    for shape in ((3, None), (4, 2), (1, None), (1, 1)):
        monkeypatch.setattr(quality, "cell_shape", lambda *a, shape=shape: shape)
        found.append({(r.labelling, r.id): r.s for r in quality._silhouettes(points, 2, None).collect()})
    assert len(found[0]) == 160 + 160 - 23
    for other in found[1:]:
        assert other == pytest.approx(found[0], abs=1e-7)
