"""SimHash near-duplicates: a grid range-join over the bit counts of fingerprint segments.

A fingerprint has 64 bits: bit b is set when over half of the hashes of the text's word
shingles have it. Its embedding is the number of set bits in each segment of ``SEGMENT`` bits.
One differing bit moves one count by at most one, so the Manhattan distance of two embeddings
is at most the number of differing bits: embeddings further apart than ``reach`` cannot belong
to linked fingerprints.

The range-join: of ``reach`` differences at most reach // 2 fall into one half of the bits, so
linked fingerprints lie within that Manhattan distance in one half at least. Each half is a
grid with a cell per embedding. A fingerprint stays in its own cell of both grids and visits
the cells that lie within the distance and come later in the order of cells, so two cells meet
in one place. Where fingerprints meet, the differing bits themselves decide. What meets is
streamed in the order of the cells; a cell with more than ``block_rows`` fingerprints is split
into blocks, whose pairs are spread over tasks. A meeting returns links that connect what it linked (fewer than it has fingerprints),
never its pairs.

Fingerprints are compared once each, whatever number of documents has them. Links are joined
to components by star contraction; the smallest id of a component is taken over distinct
fingerprints first, and rows find their component by fingerprint and a salt, so a third of all
rows with one text is spread over tasks.

A null or blank text has no shingles and fingerprint zero, linked like any other. A null id is
passed over when the smallest is taken (null where a component has no other). Repeated rows
are rows. An empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playcohort.llm.common import map_rows, text_of
from playcohort.operators.density import connected_components
from playcohort.session import staged

BITS = 64
HALF = BITS // 2
#: Bits of a segment. At distance 1 a fingerprint then is in at most 17 cells of each half, and
#: one of 150,000 random pairs of fingerprints meets.
SEGMENT = 2
SEED = 42
SHINGLE = 3
#: Shingles whose bits are added up at a time.
STRIP = 1 << 16
SALTS = 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle:] if len(words) >= shingle else ends[-1:]
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(ends, last)), dtype="<u8", count=n
    )
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, STRIP):
        octets = hashes[start : start + STRIP].view(np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``fp`` of every row of ``docs``."""
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {named.schema['id'].dataType.simpleString()}, fp long"
    return map_rows(
        named, lambda rows: {"id": rows["id"], "fp": [fingerprint(t, shingle) for t in rows["text"]]}, schema
    )


def embedding(half: Column) -> Column:
    """The counts of set bits per segment of a half, side by side in as many bits each; for
    segments of two bits, counts are at most 2 and fit into the segment itself."""
    low = F.lit(0x55555555).cast("long")
    return half.bitwiseAND(low) + F.shiftright(half, 1).bitwiseAND(low)


def steps(distance: int) -> list[tuple[tuple[int, int], ...]]:
    """The moves (segment, change) of at most ``distance`` in all that lead to later cells; the
    last segment that changes is the leading one and grows."""
    found = [()]
    for size in range(1, distance + 1):
        for segments in combinations_with_replacement(range(HALF // SEGMENT), size):
            distinct = sorted(set(segments))
            amounts = [segments.count(s) for s in distinct]
            for signs in product((1, -1), repeat=len(distinct) - 1):
                found.append(tuple((s, a * sign) for s, a, sign in zip(distinct, amounts, (*signs, 1))))
    return found


def own_cells(distinct: DataFrame) -> DataFrame:
    """``fp`` and its ``cell`` in the grid of each half: the number of the half, then the counts."""
    half = lambda i: F.shiftright("fp", HALF * i).bitwiseAND(F.lit((1 << HALF) - 1))
    cells = [embedding(half(i)) + F.lit(i << HALF).cast("long") for i in (0, 1)]
    return distinct.select("fp", F.explode(F.array(*cells)).alias("cell"))


def meetings(own: DataFrame, reach: int) -> DataFrame:
    """``fp`` and, for its own cell and each one it visits, ``at``: twice the number of the cell,
    plus one for a visit."""

    def target(move: tuple[tuple[int, int], ...]) -> Column:
        moved, inside = F.col("cell"), F.lit(True)
        for segment, change in move:
            # A visit must not lead to a count that no segment has.
            count = F.shiftright("cell", SEGMENT * segment).bitwiseAND(F.lit(3)) + change
            inside &= count.between(0, SEGMENT)
            moved = moved + F.lit(change << (SEGMENT * segment)).cast("long")
        return F.when(inside, moved * 2 + (1 if move else 0))

    visits = F.explode(F.array_compact(F.array(*[target(m) for m in steps(reach // 2)])))
    return own.select("fp", visits.alias("at"))


def in_blocks(distinct: DataFrame, reach: int, block_rows: int) -> DataFrame:
    """The meetings with a column ``part``: 0 in cells that are small enough for one group; in
    others the fingerprints are dealt into blocks, and each pair of blocks is a part.

    What meets in a cell comes from it and those around it. Where none of them has more than
    its share of ``block_rows`` the cell is small; so only what comes from crowded cells is
    counted.
    """
    own = own_cells(distinct)
    around = len(steps(reach // 2))
    crowded = staged(
        own.groupBy(F.col("cell").alias("_own")).agg(F.count("*").alias("_n")).where(F.col("_n") * around > block_rows)
    )
    from_crowded = meetings(own.join(crowded, F.col("cell") == F.col("_own"), "left_semi"), reach)
    large = staged(
        from_crowded.groupBy(F.shiftright("at", 1).alias("_cell")).agg(
            F.ceil((F.count("*") + block_rows) * 2 / block_rows).alias("_blocks")
        )
    )
    rows = meetings(own, reach).join(large, F.shiftright("at", 1) == F.col("_cell"), "left")
    block = F.pmod(F.xxhash64("fp"), "_blocks")
    others = F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)
    pair = lambda other: F.least(block, other) * F.col("_blocks") + F.greatest(block, other)
    parts = F.when(F.col("_blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, pair))
    return rows.select("at", F.explode(parts).alias("part"), "fp")


def near(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Which of ``a`` and ``b`` (unsigned, broadcast) differ in at most ``reach`` bits."""
    return np.bitwise_count(a ^ b) <= reach


def forest(hosts: np.ndarray, others: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Links between hosts, and hosts and others, that connect all that lies within reach:
    each member is linked once, when it is first reached, and not looked at as a target again."""
    points = np.concatenate([hosts, others])
    is_host = np.arange(len(points)) < len(hosts)
    left = np.arange(len(points))
    links = []
    while len(left) and left[0] < len(hosts):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            # Others meet hosts only: two others of a cell meet in a cell of theirs.
            targets = left if is_host[at] else left[: np.searchsorted(left, len(hosts))]
            hit = near(points[targets], points[at], reach)
            if hit.any():
                reached = targets[hit]
                links += [(int(points[at]), int(points[k])) for k in reached]
                front += reached.tolist()
                left = np.concatenate([targets[~hit], left[len(targets) :]])
    return links


#: Rows that are compared at a time, and the size from which a group is searched on its own.
TOGETHER = 1 << 15
SMALL = 64


def links_of(at: np.ndarray, part: np.ndarray, fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups (same cell and part) sorted by cell, part and guest. Small groups
    are compared together, the i-th neighbour of every resident at a time."""
    cell, guest = at >> 1, at & 1
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    ends, size_of = np.repeat(starts + sizes, sizes), np.repeat(sizes, sizes)
    us, vs = [fp[:0]], [fp[:0]]
    active = np.flatnonzero((guest == 0) & (size_of <= SMALL))
    for shift in range(1, SMALL):
        active = active[active + shift < ends[active]]
        if not len(active):
            break
        a, b = fp[active], fp[active + shift]
        hit = near(a, b, reach)
        us.append(a[hit])
        vs.append(b[hit])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        run = slice(start, start + size)
        hosts = guest[run] == 0
        if hosts.any():
            found = np.array(forest(fp[run][hosts], fp[run][~hosts], reach), dtype=np.uint64).reshape(-1, 2)
            us.append(found[:, 0])
            vs.append(found[:, 1])
    return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)


def link_stream(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """``links_of`` for a sorted partition, some rows at a time; the last group of what has been
    read waits for the rest of it."""

    def told(at, part, fp) -> pa.RecordBatch:
        u, v = links_of(at, part, fp, reach)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        at, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append([at, part, fp.view(np.uint64)])
        if sum(len(h[0]) for h in held) < TOGETHER:
            continue
        at, part, fp = (np.concatenate(column) for column in zip(*held))
        last = ((at >> 1) == (at[-1] >> 1)) & (part == part[-1])
        cut = len(fp) - int(last.sum())
        held = [[at[cut:], part[cut:], fp[cut:]]]
        if cut:
            yield told(at[:cut], part[:cut], fp[:cut])
    if held:
        yield told(*(np.concatenate(column) for column in zip(*held)))


def linked(distinct: DataFrame, reach: int = 3, block_rows: int = 8192) -> DataFrame:
    """Links ``u``, ``v`` that connect the fingerprints (column ``fp``, each once) that differ in at
    most ``reach`` bits."""
    met = in_blocks(distinct, reach, block_rows)
    placed = met.repartition(F.shiftright("at", 1), "part").sortWithinPartitions(F.shiftright("at", 1), "part", "at")
    return placed.mapInArrow(lambda batches: link_stream(batches, reach), "u long, v long")


def salted(df: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def components(docs: DataFrame, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``, the smallest id that the row's fingerprint reaches over
    links of at most ``reach`` differing bits."""
    rows = staged(fingerprints(docs, id_col, text_col))
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("least")))
    links = staged(linked(distinct.select("fp"), reach))
    grouped = staged(connected_components(links))
    known = grouped.join(distinct, F.col("id") == F.col("fp"))
    roots = known.groupBy("component").agg(F.min("least").alias("_least")).withColumnRenamed("component", "_root")
    moved = grouped.join(
        salted(staged(roots)), (F.col("component") == F.col("_root")) & (salt_of("id") == F.col("_salt"))
    ).select(F.col("id").alias("_moved"), "_least")
    final = distinct.join(moved, F.col("fp") == F.col("_moved"), "left").select(
        F.col("fp").alias("_fp"),
        F.when(F.col("_moved").isNull(), F.col("least")).otherwise(F.col("_least")).alias("component_id"),
    )
    same = (F.col("fp") == F.col("_fp")) & (salt_of("id") == F.col("_salt"))
    return rows.join(salted(staged(final)), same).select(F.col("id").alias(id_col), "fp", "component_id")
