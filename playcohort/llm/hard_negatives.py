"""Hard negatives by slots between the upper limits of the positives.

An anchor has up to ``n_positives`` positives, its best rows of the same label. Each positive
asks for the best rows of other labels with a score between ``low`` and ``high`` times its own. The
windows of an anchor overlap; their upper limits cut the scores into disjoint slots. A row of
another label falls into one slot, and of a slot only the best ``n_negatives`` rows can be in
any answer: the top rows under the upper limit of a window are found among the top rows of its
slot and of those below. So the searches return the best rows per slot only, from blocks
first, then over all blocks, and merging the slots from the lowest up gives the best rows
under every limit, from which the lower limit of the window takes a beginning.

Scores are inner products of integer vectors, each component floor(``scale`` * x). They are
summed in doubles where no sum can reach 2**53, else in Python integers; a score beyond 64 bits
counts as the nearest 64-bit number. Anchors and rows are dealt into blocks by a hash of a row
number, and every block of anchors meets every block of rows in a task of its own: a task
holds two blocks, and returns a bounded number of rows per anchor, whatever shares a label, an
id or a vector. The work is that of all scores of the stated anchors; more anchors or rows
give more tasks.

Rows with a null label, a null vector or a null or non-finite component take no part. Vectors
of different lengths are read as if the shorter had zeros at its end. A null id is no anchor,
comes last in ties and is returned as null. Repeated rows are rows: each is an anchor, a
positive or a negative of its own. An empty table gives an empty table. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playcohort.session import staged

#: Stands for a null id, which comes last in ties.
NO_ID = (1 << 63) - 1
#: Rows of a block; a small table is dealt into up to ``SPREAD`` blocks of ``LEAST_ROWS``.
BLOCK_ROWS = 16_384
LEAST_ROWS = 512
SPREAD = 48
#: Scores that a task holds at a time.
STRIP_CELLS = 1 << 22
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)


def participants(rows: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``row`` (a number), ``id``, ``label``, ``x`` and ``anchor`` of the rows that take part, as a
    written table."""
    named = rows.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"),
        F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"),
    )
    infinite = F.lit(math.inf)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != infinite))
    usable = named.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(True)))
    return staged(usable.select(F.monotonically_increasing_id().alias("row"), "id", "label", "x", "anchor"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists as rows of doubles, shorter ones with zeros at their end."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return int(x) * scale if abs(x) >= EXACT else math.floor(x * scale)


def score_strips(a: np.ndarray, b: np.ndarray, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """Inner products (64-bit) of the rows of ``a`` with all rows of ``b``, some rows at a time."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    rows = max(1, STRIP_CELLS // max(1, len(b)))
    top = lambda m: float(np.abs(m).max(initial=0)) * scale + 1
    if top(a) * top(b) * max(1, width) < EXACT:
        a, b = np.floor(a * scale), np.floor(b * scale)
        for start in range(0, len(a), rows):
            yield start, (a[start : start + rows] @ b.T).astype(np.int64)
        return
    wide = np.frompyfunc(lambda x: whole(x, scale), 1, 1)
    a, b = wide(a), wide(b)
    for start in range(0, len(a), rows):
        exact = a[start : start + rows].dot(b.T)
        yield start, np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties by the smaller id."""
    among = np.arange(len(scores))
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return among[np.lexsort((ids[among], ~scores[among]))[:k]]


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """Lowest and highest score in ``low`` to ``high`` hundredths of a score."""
    return -(-low * score // 100), high * score // 100


def in_blocks(
    anchors: DataFrame, rows: DataFrame, block_rows: int, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``kernel`` on every pair of a block of anchors and a block of rows."""

    def blocks(count: int) -> int:
        return max(1, -(-count // block_rows))

    n_rows = rows.count()
    by_anchor = blocks(anchors.count())
    by_row = max(blocks(n_rows), min(SPREAD, -(-n_rows // LEAST_ROWS)))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Anchors are rows of the same table: columns of their own keep the two sides apart.
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    left = own.withColumn("a", deal(by_anchor)).withColumn("r", each(by_row))
    right = rows.withColumn("r", deal(by_row)).withColumn("a", each(by_anchor))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(kernel, schema)


def ordered(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def found_rows(parts: list[dict], names: dict[str, pa.DataType]) -> pa.Table:
    """One table of the numpy columns in ``parts``."""
    return pa.table(
        {n: pa.array(np.concatenate([p[n] for p in parts]) if parts else [], type=t) for n, t in names.items()}
    )


def positives(table: DataFrame, n_positives: int, scale: int, block_rows: int) -> DataFrame:
    """``anchor`` (row number), ``anchor_id``, ``positive_id``, ``positive_score`` and ``place`` from 1."""
    names = {"anchor": pa.int64(), "anchor_id": pa.int64(), "positive_id": pa.int64(), "positive_score": pa.int64()}

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[dict] = []
        if left.num_rows and right.num_rows:
            a, b = matrix(left["x"]), matrix(right["x"])
            a_row, b_row, a_id, b_id = (ordered(t[c]) for c in ("row", "id") for t in (left, right))
            labels, _ = pd.factorize(pd.Series(left["label"].to_pylist() + right["label"].to_pylist(), dtype=object))
            a_label, b_label = labels[: len(a)], labels[len(a) :]
            for label in np.unique(a_label):
                mine, theirs = np.flatnonzero(a_label == label), np.flatnonzero(b_label == label)
                if not len(theirs):
                    continue
                for start, scores in score_strips(a[mine], b[theirs], scale):
                    for i, line in zip(mine[start : start + len(scores)], scores):
                        # One more than asked for, since the anchor itself may be among them.
                        at = best(line, b_id[theirs], n_positives + 1)
                        at = at[b_row[theirs[at]] != a_row[i]]
                        parts.append(
                            {
                                "anchor": np.full(len(at), a_row[i]),
                                "anchor_id": np.full(len(at), a_id[i]),
                                "positive_id": b_id[theirs[at]],
                                "positive_score": line[at],
                            }
                        )
        return found_rows(parts, names)

    schema = "anchor long, anchor_id long, positive_id long, positive_score long"
    found = in_blocks(table.where("anchor").drop("anchor"), table.drop("anchor"), block_rows, kernel, schema)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("place", place).where(F.col("place") <= n_positives)


def slots(
    table: DataFrame, found: DataFrame, n_negatives: int, low: int, high: int, scale: int, block_rows: int
) -> DataFrame:
    """The best ``n_negatives`` rows of another label in each slot: ``anchor``, ``slot``, ``id``, ``score``.

    A score is in the slot of the last positive whose upper limit it does not exceed.
    """
    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"])
    asked = found.groupBy("anchor").agg(scores.alias("scores")).withColumnRenamed("anchor", "_row")
    anchors = table.where("anchor").drop("anchor").join(asked, F.col("row") == F.col("_row")).drop("_row")
    names = {"anchor": pa.int64(), "slot": pa.int32(), "id": pa.int64(), "score": pa.int64()}

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[dict] = []
        if left.num_rows and right.num_rows:
            a_row, b_id = ordered(left["row"]), ordered(right["id"])
            labels, _ = pd.factorize(pd.Series(left["label"].to_pylist() + right["label"].to_pylist(), dtype=object))
            a_label, b_label = labels[: left.num_rows], labels[left.num_rows :]
            asked = left["scores"].to_pylist()
            for start, strip in score_strips(matrix(left["x"]), matrix(right["x"]), scale):
                for i, line in enumerate(strip, start):
                    windows = [limits(s, low, high) for s in asked[i]]
                    lowest = min((a for a, b in windows if a <= b), default=None)
                    if lowest is None:
                        continue
                    uppers = np.array([b for _, b in windows])
                    fits = np.flatnonzero((line >= lowest) & (line <= uppers[0]) & (b_label != a_label[i]))
                    slot = np.searchsorted(~uppers, ~line[fits], side="right")
                    for number in range(1, len(uppers) + 1):
                        at = fits[slot == number]
                        at = at[best(line[at], b_id[at], n_negatives)]
                        if len(at):
                            parts.append(
                                {
                                    "anchor": np.full(len(at), a_row[i]),
                                    "slot": np.full(len(at), number),
                                    "id": b_id[at],
                                    "score": line[at],
                                }
                            )
        return found_rows(parts, names)

    rows = in_blocks(anchors, table.drop("anchor"), block_rows, kernel, "anchor long, slot int, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= n_negatives).drop("_place")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For every anchor and each of its best ``n_positives`` rows of its label, the best
    ``n_negatives`` rows of other labels with ``low`` to ``high`` hundredths of the positive's score:
    ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score`` and
    ``negative_score``. Higher scores come first, ties by the smaller id."""
    table = participants(rows, is_anchor, id_col, vector_col, label_col)
    asked = staged(positives(table, n_positives, scale, block_rows))
    kept = staged(slots(table, asked, n_negatives, low, high, scale, block_rows))
    # Slots are disjoint and in descending order, so the merged slots of an anchor are one list.
    entry = F.struct("slot", F.bitwise_not("score").alias("under"), "id", "score")
    merged = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    exact = lambda c: c.cast("decimal(38,0)")
    floor = exact(F.col("positive_score")) * low
    under = F.slice(F.filter("found", lambda x: x["slot"] >= F.col("place")), 1, n_negatives)
    answers = F.filter(under, lambda x: exact(x["score"]) * 100 >= floor)
    known = lambda c: F.when(c != NO_ID, c)
    return (
        asked.join(merged, "anchor")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(answers).alias("at", "n"))
        .select(
            "anchor_id",
            known(F.col("positive_id")).alias("positive_id"),
            (F.col("at") + 1).cast("int").alias("rank"),
            known(F.col("n.id")).alias("negative_id"),
            "positive_score",
            F.col("n.score").alias("negative_score"),
        )
    )
