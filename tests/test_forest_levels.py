"""Forests whose levels read stored blocks once, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playcohort.operators import importance


def rows(spark):
    noise = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)).cast("double") for k in range(4)]
    return spark.range(2000).select("id", F.array(*noise).alias("x"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)).cast("int").alias("label"))


def test_levels_are_not_joined_one_after_the_other(spark, monkeypatch):
    joins, staged = [], importance.staged

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return staged(df)

    monkeypatch.setattr(importance, "staged", counted)
    trees = importance.grow_forest(rows(spark), 4, 3, 1, 150).collect()
    assert len(joins) > 5 and max(joins) <= 2
    for t in trees:
        assert t.left_over == pytest.approx(0.0, abs=1e-6) and sum(t.decreases) == pytest.approx(t.root, rel=1e-9)


def test_blocks_hold_rows_and_draws_whatever_their_size(spark, monkeypatch):
    found = []
    for size in (importance.BLOCK_ROWS, 17):
        monkeypatch.setattr(importance, "BLOCK_ROWS", size)
        blocks = importance._blocks(rows(spark).where("id < 100").coalesce(1), [[100.0, 500.0]] * 4, 5, 1).collect()
        assert len(blocks) == -(-100 // size)
        drawn = np.concatenate([np.frombuffer(b["drawn"], np.uint8).reshape(-1, 5) for b in blocks])
        x = np.concatenate([np.frombuffer(b["x"]).reshape(-1, 4) for b in blocks])
        bins = np.concatenate([np.frombuffer(b["bins"], np.uint8).reshape(-1, 4) for b in blocks])
        assert (bins == (x > 100).astype(int) + (x > 500)).all() and 0.7 < drawn.mean() < 1.3
        found.append(drawn.tolist())
    assert found[0] == found[1]


def test_subtrees_keep_counts_and_end_where_rows_are_equal():
    x = np.array([[1.0], [1.0], [2.0], [3.0], [3.0], [3.0]])
    label, weight = np.array([0, 1, 0, 1, 1, 0]), np.array([1.0, 2.0, 1.0, 1.0, 1.0, 3.0])
    decrease, root, left = importance.grow(x, label, weight, np.random.default_rng(1), 1)
    gini = lambda a, b: a + b - (a * a + b * b) / (a + b)
    assert root == pytest.approx(gini(5, 4)) and left == pytest.approx(gini(1, 2) + gini(3, 2))
    assert decrease[0] == pytest.approx(root - left)
