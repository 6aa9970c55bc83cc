import math
import random

import numpy as np
from pyspark.sql import functions as F

from playcohort.llm import hard_negatives as hn
from playcohort.llm.queries import op13_hard_negatives

LONG = 2**63 - 1


def brute(rows, n_positives=5, n_negatives=10, low=30, high=90, scale=256, step=100):
    """Rows (id, vector, label); every anchor's scores in one list."""
    rows = [
        r for r in rows
        if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    whole = [[int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in r[1]] for r in rows]
    order = lambda pair: (-pair[0], LONG if pair[1] is None else pair[1])
    out = []
    for a, (key, _, label) in enumerate(rows):
        if key is None or key % step:
            continue
        clip = lambda s: max(-LONG - 1, min(LONG, s))
        scores = [(clip(sum(x * y for x, y in zip(whole[a], v))), r[0], r[2]) for r, v in zip(rows, whole)]
        others = [s for b, s in enumerate(scores) if b != a]
        for positive, name, _ in sorted((s for s in others if s[2] == label), key=order)[:n_positives]:
            window = [s for s in others if s[2] != label and low * positive <= 100 * s[0] <= high * positive]
            for rank, (score, negative, _) in enumerate(sorted(window, key=order)[:n_negatives], 1):
                out.append((key, name, rank, negative, positive, score))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_whole_table_against_brute_force(spark, sf):
    rows = [
        (r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
        for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ]
    want = brute(rows)
    assert want and in_order(op13_hard_negatives(spark, sf).collect()) == in_order(want)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")


def test_ties_repeats_and_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)], rng.choice([1, 1, 1, 2, 3])) for i in range(400)]
    rows += rows[:30] + [(None, [1.0, 1.0, 1.0, 1.0], 2), (None, [1.0, 1.0, 0.5, 1.0], 1)]
    want = in_order(brute(rows, step=20))
    df = frame(spark, rows)
    for block_rows in (hn.BLOCK_ROWS, 50):
        assert in_order(hn.hard_negatives(df, F.col("vec_id") % 20 == 0, block_rows=block_rows).collect()) == want
    few = hn.hard_negatives(df, F.col("vec_id") % 20 == 0, n_positives=2, n_negatives=3, low=50, high=100).collect()
    assert in_order(few) == in_order(brute(rows, 2, 3, 50, 100, step=20))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rng = random.Random(2)
    rows = [
        (0, [1e300, -2.5], 1), (1, [1e300, 3.0], 1), (2, [1e150, 1.0], 2), (100, [3e15, 0.1, 7.0], 1), (101, [3e15], 1),
        (102, [2e15, 5.0], 2), (200, [], 1), (201, [], 1), (202, [], 2), (300, None, 1), (301, [1.0], None),
        (302, [inf], 1), (303, [nan, 1.0], 2), (304, [None, 1.0], 2), (400, [-1.0, -2.0], 3), (401, [1.0, 2.0], 3),
        (402, [1.0], 4), (500, [1.0, 1.0], 5), (None, [1.0, 0.9], 6),
    ]
    rows += [(1000 + i, [rng.uniform(-1, 1) for _ in range(3)], rng.choice([1, 2, 3])) for i in range(101)]
    df = frame(spark, rows).withColumn("row", F.lit("x")).withColumn("anchor", F.lit("y")).withColumn("x", F.lit(1))
    got = hn.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    assert in_order(got) == in_order(brute(rows))
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    words = df.withColumn("label", F.concat(F.lit("l"), "label"))
    assert in_order(hn.hard_negatives(words, F.col("vec_id") % 100 == 0).collect()) == in_order(got)


def test_best_of_many_ties():
    rng = np.random.default_rng(3)
    for _ in range(50):
        scores, ids = rng.integers(0, 4, 200), rng.permutation(200)
        want = sorted(range(200), key=lambda k: (-scores[k], ids[k]))[:10]
        assert hn.best(scores, ids, 10).tolist() == want


def test_a_task_returns_few_rows(spark, sf):
    """A block answers with at most the asked rows per slot, however many fit."""
    rows = [(i, [1.0, i / 5000], i % 2) for i in range(5000)]
    table = hn.participants(frame(spark, rows), F.col("vec_id") % 1000 == 0, "vec_id", "embedding", "label")
    asked = hn.positives(table, 5, 256, 1000)
    assert asked.count() == 25
    kept = hn.slots(table, asked, 10, 30, 100, 256, 1000)
    assert kept.groupBy("anchor", "slot").count().agg(F.max("count")).first()[0] <= 10
