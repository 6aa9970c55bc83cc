"""Work over pairs of points, without ever listing the pairs.

The points are dealt into blocks, by a hash or by their nearest pivot; a cell is an unordered pair of blocks, and one task
turns a cell into per-point results with matrix products. The number of blocks grows with
the number of points, so a task always holds about two blocks, whatever the size of the
table or of any cluster in it. The distance work itself stays quadratic.

Sums over all points have cells of their own shape (``over_rectangles``): two blocks that add up for
each other, or, where a point has many sums, a block of rows, for which sums are kept, and a chunk of
columns. All are as large as memory allows, since every point is sent to as many cells as there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from playcohort.session import staged

BLOCK_ROWS = 4096
_LARGE_BLOCK_ROWS = 32_768
_STRIP_CELLS = 1 << 22


def block_rows_for(count: int) -> int:
    """Rows per block: larger blocks for larger tables, since every point is sent to as many
    cells as there are blocks."""
    return min(_LARGE_BLOCK_ROWS, max(BLOCK_ROWS, count // 256))


def point_arrays(points: DataFrame, id_col: str) -> DataFrame:
    """(id, x array<double>, other columns) from a vector or array ``features`` column."""
    kind = points.schema["features"].dataType
    x = (
        F.col("features").cast("array<double>")
        if isinstance(kind, T.ArrayType)
        else vector_to_array("features")
    )
    others = [c for c in points.columns if c not in (id_col, "features")]
    return points.select(F.col(id_col).alias("id"), x.alias("x"), *others)


def over_block_pairs(
    points: DataFrame, count: int, kernel: Callable, schema: str, block_rows: int | None = None, blocks: int | None = None
) -> DataFrame:
    """Run ``kernel(left, right, same)`` on every cell and return its rows.

    ``left`` and ``right`` are pandas frames of two blocks, with ``same`` the block meets
    itself. Results for both sides of a cell are up to the kernel.
    """
    blocks = blocks or max(1, -(-count // (block_rows or block_rows_for(count))))
    placed = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = placed.withColumn("other", other).select(
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *placed.columns
    )

    return _on_cells(cells, kernel, schema)


#: Bytes a task holds of the rows with their sums, and of the columns of a cell.
_ROW_BYTES = 96 << 20
_COLUMN_BYTES = 128 << 20
#: Blocks and chunks of a table that would need fewer, so that there are cells for many tasks.
_SPREAD_BLOCKS, _SPREAD_CHUNKS, _PAIR_BLOCKS = 12, 6, 10


def rectangle_counts(count: int, row_numbers: int, column_numbers: int, block_rows: int | None = None) -> tuple[int, int]:
    """Blocks and chunks for ``count`` points, of which a task holds ``row_numbers`` numbers each
    for those of a block and ``column_numbers`` for those of a chunk. A chunk is made of whole
    blocks: that of a block is its number modulo the chunks."""

    def parts(numbers: int, held: int, spread: int) -> int:
        most = block_rows or max(1, held // (8 * numbers))
        return max(1, -(-count // most), min(spread, -(-count // BLOCK_ROWS)))

    chunks = parts(column_numbers, _COLUMN_BYTES, _SPREAD_CHUNKS)
    blocks = parts(row_numbers, _ROW_BYTES, _SPREAD_BLOCKS)
    return chunks * -(-blocks // chunks), chunks


def cell_shape(count: int, width: int, sums: int, block_rows: int | None = None) -> tuple[int, int | None]:
    """(blocks, chunks) for points of ``width`` numbers that get ``sums`` sums each. ``chunks`` is None
    where every pair of blocks is to meet once and add up for both sides: half the distances, but sums of
    a point for every block. Where they are so many that more than twice as much would be moved, blocks
    meet chunks and add up for the blocks only."""
    blocks, chunks = rectangle_counts(count, width + sums, width, block_rows)
    most = block_rows or max(1, _ROW_BYTES // (8 * (width + sums)))
    pairs = max(1, -(-count // most), min(_PAIR_BLOCKS, -(-count // BLOCK_ROWS)))
    if pairs * (width + sums) <= 2 * ((blocks + chunks - 1) * width + chunks * sums):
        return pairs, None
    return blocks, chunks


def over_rectangles(points: DataFrame, blocks: int, chunks: int | None, kernel: Callable, schema: str) -> DataFrame:
    """Run ``kernel(rows, columns, own, other)`` on every block and chunk and return its rows.

    Both are pandas frames, ``other`` the number of the chunk. Where the chunk holds the block, ``own`` says which
    of its columns the rows are; elsewhere it is None. Such points are sent once. Without ``chunks`` every
    pair of blocks meets once, and ``other`` has the numbers of both: (that of the columns, that of the rows).
    """
    placed = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = F.sequence(F.lit(0), F.lit((chunks or blocks) - 1))
    if chunks is None:
        met = F.transform(every, lambda j: cell(F.least("block", j), F.greatest("block", j)))
    else:
        as_row = F.transform(every, lambda j: cell(F.col("block"), j))
        others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i != F.col("block"))
        met = F.concat(as_row, F.transform(others, lambda i: cell(i, F.col("block") % chunks)))
    cells = placed.select(F.inline(met), *placed.columns)
    names = T.StructType.fromDDL(schema).names

    def run(pdf):
        import numpy as np
        import pandas as pd

        i, j, block = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), pdf["block"].to_numpy()
        rows = np.flatnonzero(block == i)
        columns = np.flatnonzero(block == j if chunks is None else block % chunks == j)
        if not len(rows) or not len(columns):
            return pd.DataFrame(columns=names)
        same = i == j if chunks is None else i % chunks == j
        own = np.searchsorted(columns, rows) if same else None
        return kernel(pdf.iloc[rows], pdf.iloc[columns], own, j if chunks is not None else (j, i))

    return cells.groupBy("i", "j").applyInPandas(run, schema)


def distance_tiles(a, b, rows: int = 256, columns: int = 4096):
    """(row slice, column slice, Euclidean distances) over tiles of the table of distances; the
    squares come out of one matrix product. Both sides are moved to the middle of ``a``, as below."""
    import numpy as np

    middle = a.mean(axis=0)
    a = a - middle
    left = np.concatenate([-2.0 * a, (a * a).sum(axis=1)[:, None], np.ones((len(a), 1))], axis=1)
    for start in range(0, len(b), columns):
        # The columns of one tile are copied at a time, never all of them.
        moved = b[start : start + columns] - middle
        part = np.concatenate([moved, np.ones((len(moved), 1)), (moved * moved).sum(axis=1)[:, None]], axis=1)
        part = np.ascontiguousarray(part.T)
        for first in range(0, len(a), rows):
            sq = left[first : first + rows] @ part
            # Rounding takes few tiles below zero.
            if not sq.min() >= 0.0:
                np.maximum(sq, 0.0, out=sq)
            yield slice(first, first + len(sq)), slice(start, start + sq.shape[1]), np.sqrt(sq, out=sq)


def _on_cells(cells: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` on every (lo, hi), of which ``block`` is one."""
    names = T.StructType.fromDDL(schema).names

    def run(pdf):
        import pandas as pd

        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        left = pdf[pdf["block"] == lo].reset_index(drop=True)
        right = left if lo == hi else pdf[pdf["block"] == hi].reset_index(drop=True)
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        return kernel(left, right, lo == hi)

    return cells.groupBy("lo", "hi").applyInPandas(run, schema)


#: Pivots at most; they are fetched to the driver and sent to tasks.
PIVOTS = 1024


@dataclass
class PivotBlocks:
    """Points (id, x, ``block``, ``away`` from the pivot of the block), and for each block, by its
    number, the pivot and the radius: a few numbers per block of ``block_rows`` points."""

    points: DataFrame
    centres: object
    radii: object


def pivot_blocks(arrays: DataFrame, count: int, block_rows: int | None = None) -> PivotBlocks:
    """Blocks of points that lie together: by the nearest of up to ``PIVOTS`` points (drawn by
    their hash), a crowded neighbourhood in several blocks by a hash of the id."""
    import numpy as np

    size = block_rows or block_rows_for(count)
    drawn = arrays.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, -(-count // size)))).select("x").collect()
    pivots = np.array([r["x"] for r in drawn], dtype=float).reshape(len(drawn), -1)

    def place(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.empty((0, pivots.shape[1]))
            at, away = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf)
            for k, pivot in enumerate(pivots):
                d = direct_distances(x, pivot)
                nearer = d < away
                at[nearer], away[nearer] = k, d[nearer]
            yield pdf.assign(pivot=at, away=away)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.schema.fields)
    placed = staged(arrays.mapInPandas(place, f"{kind}, pivot int, away double"))
    rows = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, -(-rows.get(k, 0) // size)) for k in range(len(pivots))]
    firsts = np.cumsum([0, *parts])
    lit = lambda values: F.array(*[F.lit(int(v)) for v in values])
    first, n = F.get(lit(firsts), F.col("pivot")), F.get(lit(parts), F.col("pivot"))
    points = staged(placed.withColumn("block", (first + F.pmod(F.xxhash64("id"), n)).cast("int")).drop("pivot"))
    radii = np.full(int(firsts[-1]), -np.inf)
    for r in points.groupBy("block").agg(F.max("away").alias("r")).collect():
        radii[r["block"]] = r["r"]
    return PivotBlocks(points, np.repeat(pivots, parts, axis=0), radii)


def meeting_blocks(centres, radii, reach, block: int):
    """The later blocks that may hold a point within reach of one of ``block``, or the other way
    round: by the triangle inequality no distance is below that of the pivots less both radii."""
    import numpy as np

    gap = direct_distances(centres, centres[block]) - radii - radii[block]
    # Room for rounding in the sums above.
    room = 1e-9 * (1.0 + np.abs(centres).max(initial=0.0))
    near = (gap <= np.maximum(reach, reach[block]) + room) & np.isfinite(radii)
    return np.flatnonzero(near & (np.arange(len(radii)) > block))


def over_meeting_blocks(blocks: PivotBlocks, points: DataFrame, reach, kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` on the pairs of different blocks that may hold points within ``reach`` (an array,
    one number per block) of each other. ``points`` are those of ``blocks``, with more columns."""
    import pandas as pd

    centres, radii = blocks.centres, blocks.radii

    def partners(batches):
        for pdf in batches:
            for lo in pdf["id"]:
                found = meeting_blocks(centres, radii, reach, int(lo))
                yield pd.DataFrame({"lo": int(lo), "hi": found})

    pairs = points.sparkSession.range(len(radii)).mapInPandas(partners, "lo int, hi int")
    pairs = staged(pairs)
    ends = pairs.select(F.col("lo").alias("block"), "lo", "hi").union(pairs.select(F.col("hi"), "lo", "hi"))
    return _on_cells(points.join(ends, "block"), kernel, schema)


def reach_of_blocks(blocks: PivotBlocks, bounds: DataFrame):
    """The numbers of ``bounds`` (block, d) in the order of the blocks: one per block."""
    import numpy as np

    reach = np.full(len(blocks.radii), -np.inf)
    for r in bounds.collect():
        reach[r["block"]] = r["d"]
    return reach


def direct_distances(a, b):
    """Distances of rows, from the differences of their entries: exact to the last digits
    wherever the points lie, and the same in every block."""
    import numpy as np

    gap = a - b
    return np.sqrt((gap * gap).sum(axis=1))


def _at_a_time(rows, columns, a, b, step: int = 1 << 16):
    import numpy as np

    parts = [direct_distances(a[rows[k : k + step]], b[columns[k : k + step]]) for k in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def square_strips(a, b, cells: int = _STRIP_CELLS):
    """(start, squared distances, how far they may be off) of a strip of rows of ``a`` to all of
    ``b``, by matrix products; for choosing what is then looked at by ``direct_distances``."""
    import numpy as np

    middle = a.mean(axis=0)
    a, b = a - middle, b - middle
    rows = max(1, cells // max(1, len(b)))
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    off = 4e-16 * (a.shape[1] + 8) * (np.sqrt(aa.max(initial=0.0)) + np.sqrt(bb.max(initial=0.0))) ** 2
    for start in range(0, len(a), rows):
        part = a[start : start + rows]
        yield start, aa[start : start + rows, None] + bb[None, :] - 2.0 * (part @ b.T), off


def nearest(a, b, k: int, same: bool):
    """(rows of ``a``, distances): the ``k`` least distances of each row of ``a`` to other rows of
    ``b`` (all, where there are fewer). With ``same``, row i of both is one point."""
    import numpy as np

    found = []
    for start, sq, off in square_strips(a, b):
        if same:
            sq[np.arange(len(sq)), np.arange(start, start + len(sq))] = np.inf
        take = min(k, sq.shape[1])
        kth = np.partition(sq, take - 1, axis=1)[:, take - 1]
        rows, columns = np.nonzero((sq <= kth[:, None] + 2 * off) & np.isfinite(sq))
        d = _at_a_time(rows + start, columns, a, b)
        order = np.lexsort((d, rows))
        rows, d = rows[order], d[order]
        firsts = np.searchsorted(rows, rows)
        kept = np.arange(len(rows)) - firsts < take
        found.append((rows[kept] + start, d[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest_within(a, b, k: int, bound):
    """``nearest`` for two different blocks, without what is farther than ``bound``, a distance for
    each row of ``a``; infinity is none."""
    import numpy as np

    found = []
    free = np.flatnonzero(np.isinf(bound))
    if len(free):
        rows, d = nearest(a[free], b, k, False)
        found.append((free[rows], d))
    tied = np.flatnonzero(~np.isinf(bound))
    a, bound = a[tied], bound[tied]
    for start, sq, off in square_strips(a, b) if len(tied) else []:
        limit = bound[start : start + len(sq)]
        rows, columns = np.nonzero(sq <= (limit * limit + 2 * off)[:, None])
        d = _at_a_time(rows + start, columns, a, b)
        order = np.lexsort((d, rows))
        rows, d = rows[order], d[order]
        kept = (np.arange(len(rows)) - np.searchsorted(rows, rows) < k) & (d <= limit[rows])
        found.append((tied[rows[kept] + start], d[kept]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, dtype=np.int64), np.empty(0))


def near_strips(a, b, eps: float):
    """(start, flags): which rows of ``b`` lie within ``eps`` of a strip of rows of ``a``; what is
    close to the edge is decided by the direct distance."""
    import numpy as np

    for start, sq, off in square_strips(a, b):
        near = sq <= eps * eps
        rows, columns = np.nonzero(np.abs(sq - eps * eps) <= 2 * off + 1e-12 * eps * eps)
        near[rows, columns] = _at_a_time(rows + start, columns, a, b) <= eps
        yield start, near


def distance_strips(a, b, cells: int = _STRIP_CELLS):
    """Euclidean distances of the rows of ``a`` to all rows of ``b``, a strip at a time; a
    strip has a bounded number of entries.

    Both sides are moved to the middle of ``a`` first: the product form loses the digits that
    a large common offset takes up.
    """
    import numpy as np

    middle = a.mean(axis=0)
    a, b = a - middle, b - middle
    rows = max(1, cells // max(1, len(b)))
    bb = (b * b).sum(axis=1)
    for start in range(0, len(a), rows):
        part = a[start : start + rows]
        sq = (part * part).sum(axis=1)[:, None] + bb[None, :] - 2.0 * (part @ b.T)
        np.maximum(sq, 0.0, out=sq)
        yield start, np.sqrt(sq, out=sq)
