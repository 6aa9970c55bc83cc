"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

Equal texts form a class and are looked at once. Candidates are found by MinHash banding:
each of ``trees`` bands labels a text with the hash of its first MinHash values, and texts with
a common label are tied to the smallest of them, so a run of n texts gives n - 1 candidate
edges. The values a band has follow from the threshold, the number of bands and ``recall``,
the least probability that a pair at the threshold shares a label (see ``prefix_length``).
Sequences are cut at that one length: no trie is sorted, and no prefix is lengthened or
shortened by what it matches.

Connected candidates are then verified exactly, on the full shingle sets: all pairs of a
candidate component are compared by products of its text-by-shingle matrix, and what leaves a
task is one row per text, its number of links and the smallest text it is linked with.
Components of more than ``block_texts`` texts are cut into blocks and every pair of blocks is a
task, so a task's memory is bounded and no pair is lost, capped or listed.

Words are the lower-cased runs between white space; a shingle is ``shingle`` words in a row, or
all words of a shorter text. Null texts count as empty; a text without words has no shingles
and is linked with its copies only. Repeated rows are copies. An empty table gives an empty
table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playcohort.llm.common import bounded_batches, fresh, text_of
from playcohort.session import staged

MASK = (1 << 64) - 1
#: Odd multipliers of the shingle and MinHash functions follow from this seed.
SEED = 0x9E3779B97F4A7C15
#: Columns of the text-by-shingle matrix that are multiplied at once.
STRIP = 8192


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (a multiply and xor-shift finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a text, sorted."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    size = min(size, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    last = len(words) - size + 1
    total = np.full(last, size, dtype=np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(SEED) + hashes[i : i + last])
    return np.unique(total)


def prefix_length(threshold: float, recall: float, trees: int, longest: int) -> int:
    """The longest prefix at which a pair at the threshold is found with probability ``recall``."""
    for length in range(longest, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError(f"{trees} trees cannot reach a recall of {recall}")


def labels_of(shingles: np.ndarray, multipliers: np.ndarray, trees: int) -> list[int]:
    """One label per tree: a hash of the first values of its MinHash sequence."""
    low = np.full(len(multipliers), MASK, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = mixed(shingles[at : at + 4096, None] * multipliers[None, :])
        low = np.minimum(low, part.min(axis=0))
    sequences = low.reshape(trees, -1)
    label = np.arange(trees, dtype=np.uint64)
    for i in range(sequences.shape[1]):
        label = mixed(label * np.uint64(SEED) + sequences[:, i])
    return label.view(np.int64).tolist()


def labelled(texts: DataFrame, shingle: int, trees: int, depth: int) -> DataFrame:
    """``key`` and ``labels`` of every row of ``texts`` (key, text); no labels without words."""
    bounded_batches(texts.sparkSession)
    rng = np.random.default_rng(SEED)
    multipliers = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    target = pa.schema([("key", pa.binary()), ("labels", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out = []
                for text in batch.column(1).to_pylist():
                    shingles = shingle_set(text, shingle)
                    out.append(labels_of(shingles, multipliers, trees) if len(shingles) else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(out, target.field(1).type)], schema=target
                )

    return texts.mapInArrow(run, "key binary, labels array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node) of each component with an edge between ``a`` and ``b``.

    Every node is merged into its smallest neighbour and the edges are carried over, until
    none is left. Each round is written, so lineage stays short.
    """
    edges = staged(edges.where(F.col("a") != F.col("b")).distinct())
    nodes = staged(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        into = staged(both.groupBy(F.col("a").alias("old")).agg(F.least(F.min("b"), F.first("a")).alias("new")))
        nodes = staged(
            nodes.join(into, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        )
        one = edges.join(into, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
        two = one.join(into, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        edges = staged(two.where(F.col("a") != F.col("b")).distinct())
    return nodes


def candidates(classes: DataFrame, shingle_labels: str = "labels") -> DataFrame:
    """Edges from each text to the smallest text that shares its prefix, for every tree."""
    nodes = classes.select("key", F.posexplode(shingle_labels).alias("tree", "label"))
    runs = (
        nodes.groupBy("tree", "label")
        .agg(F.min("key").alias("hub"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select(F.col("tree").alias("_tree"), F.col("label").alias("_label"), "hub")
    )
    same = (F.col("tree") == F.col("_tree")) & (F.col("label") == F.col("_label"))
    return nodes.join(runs, same).where(F.col("key") != F.col("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b"))


def similar(sets: list[np.ndarray], others: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which pairs of ``sets`` and ``others`` reach the threshold, by counting common shingles."""
    sizes, other_sizes = (np.array([len(s) for s in x], dtype=np.int64) for x in (sets, others))
    everything = np.concatenate([*sets, *others])
    owner = np.repeat(np.arange(len(sets) + len(others)), np.concatenate([sizes, other_sizes]))
    values, column, counts = np.unique(everything, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(others)), dtype=np.float64)
    width = int((counts > 1).sum())
    for low in range(0, width, STRIP):
        a, b = np.searchsorted(column, [low, low + STRIP])
        matrix = np.zeros((len(sets) + len(others), min(STRIP, width - low)), dtype=np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        common += matrix[: len(sets)] @ matrix[len(sets) :].T
    union = sizes[:, None] + other_sizes[None, :] - common
    return common * threshold.denominator >= union * threshold.numerator


def smallest_linked(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the smallest index in its component."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root[None, :], len(links)).min(axis=1)
        low = np.minimum(low, root)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def verified(members: DataFrame, shingle: int, threshold: Fraction, block_texts: int) -> DataFrame:
    """Links of the texts of candidate components.

    ``members`` has root (of the component), key, text, copies. Gives for each key and task:
    ``root`` (the smallest key it is connected with there), ``texts`` and ``docs``, the numbers
    of other texts and of their documents that it is linked with.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("_n")).withColumnRenamed("root", "_root")
    blocks = F.ceil(F.col("_n") / block_texts).cast("long")
    placed = (
        members.join(sizes, F.col("root") == F.col("_root"))
        .withColumn("_blocks", blocks)
        .withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_blocks")))
    )
    # A task is a bin of whole components, or two blocks of a large one.
    total = members.count()
    bins = max(1, -(-total // block_texts))
    bin_of = F.struct(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("x"), F.lit(-1).cast("long").alias("y"))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    small = placed.where(F.col("_blocks") == 1).select("*", bin_of.alias("_task"), F.lit(None).cast("binary").alias("_of"))
    pair = F.struct(F.least("_own", "_with").alias("x"), F.greatest("_own", "_with").alias("y"))
    large = (
        placed.where(F.col("_blocks") > 1)
        .withColumn("_with", partner)
        .select(*placed.columns, pair.alias("_task"), F.col("root").alias("_of"))
    )
    tasks = small.unionByName(large).select(
        F.struct("_task", "_of").alias("_task"), (F.col("_task.x") < F.col("_task.y")).alias("_across"), "root", "key", "text", "copies", "_own"
    )
    target = pa.schema(
        [("key", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64())]
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("root", "ascending"), ("key", "ascending")])
        roots, keys, own = (group.column(c).to_pylist() for c in ("root", "key", "_own"))
        copies = group.column("copies").to_numpy()
        across = group.column("_across")[0].as_py()
        with np.errstate(over="ignore"):
            sets = [shingle_set(text, shingle) for text in group.column("text").to_pylist()]
        out: dict[str, list] = {name: [] for name in target.names}
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and roots[end] == roots[start]:
                end += 1
            side = np.array(own[start:end])
            # Inside a block its pairs are compared once; between two blocks only across.
            here = sets[start:end]
            if across:
                left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side > side.min())
                links = np.zeros((end - start, end - start), dtype=bool)
                found = similar([here[i] for i in left], [here[i] for i in right], threshold)
                links[np.ix_(left, right)] = found
                links[np.ix_(right, left)] = found.T
            else:
                links = similar(here, here, threshold)
                np.fill_diagonal(links, False)
            root = smallest_linked(links)
            out["key"] += keys[start:end]
            out["root"] += [keys[start + i] for i in root]
            out["texts"] += links.sum(axis=1).tolist()
            out["docs"] += (links @ copies[start:end]).tolist()
            start = end
        return pa.Table.from_pydict(out, schema=target)

    # The text leaves a task as counts only.
    return tasks.groupBy("_task").applyInArrow(compare, "key binary, root binary, texts bigint, docs bigint")


def joined(
    rows: DataFrame,
    shingle: int = 5,
    threshold: Fraction = Fraction(4, 5),
    trees: int = 32,
    recall: float = 0.999,
    longest: int = 12,
    block_texts: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """Links of the texts of ``rows`` (text only): (key, copies) and (key, root, texts, docs).

    The second table has only the texts that were compared.
    """
    depth = prefix_length(float(threshold), recall, trees, longest)
    keyed = rows.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    classes = staged(
        labelled(keyed, shingle, trees, depth).groupBy("key").agg(F.first("labels").alias("labels"), F.count("*").alias("copies"))
    )
    near = components(candidates(classes))
    members = near.join(classes.select("key", "copies"), F.col("node") == F.col("key")).select("key", "root", "copies")
    wanted = members.withColumnRenamed("key", "_key")
    with_text = staged(
        keyed.join(wanted, F.col("key") == F.col("_key")).groupBy("key", "root", "copies").agg(F.first("text").alias("text"))
    )
    links = staged(verified(with_text, shingle, threshold, block_texts))
    summed = links.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    connected = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = summed.join(connected, F.col("key") == F.col("node"), "left").select(
        "key", F.coalesce("root", "key").alias("root"), "texts", "docs"
    )
    return classes.select("key", "copies"), linked


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, ``class_id``, ``n_links``, ``n_text_links``.

    A class is a set of documents connected by links; its id is the smallest id in it (null
    if it has none). ``n_links`` counts the other documents at or above the threshold, copies
    included, ``n_text_links`` the different texts among them.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    classes, linked = joined(rows.select("text"), **options)
    renamed = linked.withColumnRenamed("key", "_key")
    each = classes.join(renamed, F.col("key") == F.col("_key"), "left").select(
        F.col("key").alias("_of"),
        F.coalesce("root", "key").alias("root"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
    narrow = rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    placed = staged(narrow.join(each, F.col("key") == F.col("_of")).select("id", "root", "n_links", "n_text_links"))
    ids = placed.groupBy("root").agg(F.min("id").alias("class_id")).withColumnRenamed("root", "_root")
    return placed.join(ids, F.col("root") == F.col("_root")).select(
        F.col("id").alias(id_col), "class_id", "n_links", "n_text_links"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every class, the one with the smallest id, and all its columns."""
    row = fresh(docs, "_row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    _, linked = joined(rows.select("text"), **options)
    roots = linked.select(F.col("key").alias("_key"), "root")
    narrow = rows.select("row", "id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    placed = staged(
        narrow.join(roots, F.col("key") == F.col("_key"), "left").select("row", "id", F.coalesce("root", "key").alias("root"))
    )
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("_best"))
    # The kept rows have no bound, so they are never broadcast; the row numbers spread evenly.
    best = first.select(F.col("_best.row").alias("_kept")).hint("merge")
    return numbered.join(best, F.col(row) == F.col("_kept"), "left_semi").drop(row)
