"""Which features tell the clusters apart: a random forest whose trees are grown in full.

A tree sees each row as often as a Poisson draw of mean 1 says, taken from a hash of row and
tree, so trees repeat and no row is shuffled to be drawn. Rows are stored once, in blocks, with a byte
for the draw of each tree and one for the bin of each feature. A node with more than
``group_rows`` drawn rows is split by the counts of labels in bins of a random choice of
features, added up over all tasks. A level reads the blocks once: a task leads the drawn rows down the
splits so far, which come with each block, and counts those in nodes that are still to be split.
A smaller node is handed
to one task, which finishes its subtree, down to nodes of one label or of equal rows, with
splits between any two values. So depth has no limit, and no task holds more rows than that.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from playcohort.operators.prep import assemble, median_impute
from playcohort.session import staged

GROUP_ROWS = 32_768
BINS = 64
#: Rows of a stored block, and counts that a task holds.
BLOCK_ROWS = 16_384
COUNT_CELLS = 4_000_000
#: Cumulative shares of a Poisson distribution of mean 1: rows drawn 0, 1, 2, ... times.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(12)])


def impurity(counts: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity, from the counts of labels along the last axis."""
    total = counts.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mixed = total - (counts * counts).sum(axis=-1) / total
    return np.where(total > 0, np.maximum(mixed, 0.0), 0.0)


def grow(x: np.ndarray, label: np.ndarray, weight: np.ndarray, rng: np.random.Generator, tried: int):
    """(decrease of impurity per feature, impurity of the root, and what is left in the leaves).

    Weights are whole numbers above 0, so sums do not depend on the order of the rows. A node knows the counts of
    its labels and its impurity from the split that made it; only impure ones are looked at again."""
    decrease, left_over = np.zeros(x.shape[1]), 0.0
    columns = np.ascontiguousarray(x.T)
    classes, label = np.unique(label, return_inverse=True)
    drawn = np.zeros((len(classes), len(x)))
    drawn[label, np.arange(len(x))] = weight
    counts = drawn.sum(axis=1)
    root = float(impurity(counts)) if len(x) else 0.0
    stack = [(np.arange(len(x)), counts, root)] if root > 1e-9 else []
    left_over += 0.0 if stack else root
    while stack:
        rows, counts, here = stack.pop()
        features = rng.permutation(len(columns))
        if len(rows) == 2:
            # Any feature that tells the two apart leaves nothing; the first one is taken.
            apart = (columns[features, rows[0]] != columns[features, rows[1]]).nonzero()[0]
            if len(apart):
                decrease[features[apart[0]]] += here
            else:
                left_over += here
            continue
        # More features are tried as long as none can split the node.
        for start in range(0, len(features), tried):
            some = features[start : start + tried, None]
            values = columns[some, rows]
            order = values.argsort(axis=1, kind="stable")
            line = np.arange(len(some))[:, None]
            values, placed = values[line, order], rows[order]
            below = drawn.take(placed[:, :-1], axis=1)
            below.cumsum(axis=2, out=below)
            above = counts[:, None, None] - below
            low, high = below.sum(axis=0), above.sum(axis=0)
            low_cost = np.maximum(low - np.einsum("cij,cij->ij", below, below) / low, 0.0)
            high_cost = np.maximum(high - np.einsum("cij,cij->ij", above, above) / high, 0.0)
            split = low_cost + high_cost
            split[values[:, 1:] == values[:, :-1]] = np.inf
            at = split.argmin(axis=1)
            costs = split[line[:, 0], at]
            k = int(costs.argmin())
            cost = float(costs[k])
            if cost < np.inf:
                break
        else:
            left_over += here
            continue
        decrease[features[start + k]] += here - cost
        cut = int(at[k])
        for side, n, left in (
            (placed[k, : cut + 1], below[:, k, cut], float(low_cost[k, cut])),
            (placed[k, cut + 1 :], above[:, k, cut], float(high_cost[k, cut])),
        ):
            if left > 1e-9:
                stack.append((side, n.copy(), left))
            else:
                left_over += left
    return decrease, root, left_over


def _features_of(tree: int, node: int, width: int, tried: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, node & ((1 << 63) - 1)]).permutation(width)[:tried]


def _blocks(rows: DataFrame, edges: list[list[float]], n_trees: int, seed: int) -> DataFrame:
    """``rows`` (id, x, label) in blocks of ``BLOCK_ROWS``: ``x``, ``label``, ``drawn``, for each tree how often it
    draws a row, and ``bins``, for each feature the edges below the value of a row."""
    ticket = lambda tree: F.pmod(F.xxhash64(F.col("id"), tree, F.lit(seed)), F.lit(1 << 40))
    tickets = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), ticket)

    def block(table):
        import pyarrow as pa

        x = np.stack(table.column("x").to_numpy()).astype(float, copy=False)
        u = np.stack(table.column("tickets").to_numpy()) / float(1 << 40)
        drawn = np.searchsorted(_POISSON, u, side="right").astype(np.uint8)
        bins = np.empty((len(x), len(edges)), dtype=np.uint8)
        for f, e in enumerate(edges):
            bins[:, f] = np.searchsorted(e, x[:, f], side="left")
        label = table.column("label").to_numpy().astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([v.tobytes()], pa.binary()) for v in (x, label, drawn, bins)], ["x", "label", "drawn", "bins"]
        )

    def run(batches):
        import pyarrow as pa

        waiting, held = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and len(batch):
                waiting.append(batch)
                held += len(batch)
            if waiting and (batch is None or held >= BLOCK_ROWS):
                table = pa.Table.from_batches(waiting)
                for start in range(0, held, BLOCK_ROWS):
                    yield block(table.slice(start, BLOCK_ROWS))
                waiting, held = [], 0

    given = rows.select("x", F.col("label").cast("int").alias("label"), tickets.alias("tickets"))
    return given.mapInArrow(run, "x binary, label binary, drawn binary, bins binary")


def _in_order(batch, name: str, fields: list[str]) -> list[tuple]:
    """The structs of a list column, which is the same in all rows."""
    values = batch.column(name)[0].values
    return list(zip(*(values.field(f).to_pylist() for f in fields))) if len(values) else []


def _nodes_of(batch) -> dict[int, dict[int, tuple]]:
    """By tree: node to (feature, bin, low child, high child)."""
    known: dict[int, dict[int, tuple]] = {}
    for tree, node, *split in _in_order(batch, "splits", ["tree", "node", "feature", "bin", "low", "high"]):
        known.setdefault(tree, {})[node] = tuple(split)
    return known


def _led_down(known: dict[int, tuple], rows: np.ndarray, bins: np.ndarray):
    """(node, rows) for the nodes of a tree that have no split, starting with all ``rows`` at the root. Rows
    of a node that could not be split are left out."""
    stack = [(0, rows)]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node not in known:
            yield node, rows
            continue
        feature, at, low, high = known[node]
        if feature is not None:
            below = bins[rows, feature] <= at
            stack += [(low, rows[below]), (high, rows[~below])]


def _with_splits(blocks: DataFrame, splits: DataFrame, **more: DataFrame) -> DataFrame:
    """Each block with the splits so far, and other tables, as arrays: a row per large node."""
    for name, table in {"splits": splits.select("tree", "node", "feature", "bin", "low", "high"), **more}.items():
        one = table.agg(F.collect_list(F.struct(*table.columns)).alias(name))
        blocks = blocks.join(F.broadcast(one), F.lit(True))
    return blocks


def _unpacked(batch, i: int, n_trees: int):
    """Label, draws (a row per tree) and bins (a column per feature) of a block."""
    part = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)
    label = part("label", np.int32)
    drawn = np.ascontiguousarray(part("drawn", np.uint8).reshape(len(label), n_trees).T)
    return label, drawn, part("bins", np.uint8).reshape(len(label), -1)


def _split_level(blocks: DataFrame, splits: DataFrame, large: DataFrame, edges: list[list[float]], n_trees: int, tried: int, seed: int) -> DataFrame:
    """(tree, node, feature, bin, at, decrease, root, low_rows, high_rows): the best split of each node of ``large``
    between bins, at the upper edge ``at`` of ``bin``, and the drawn rows on both sides; ``feature`` null where no
    bins differ."""
    width = len(edges)
    # Twice as many as a node in a task tries: bins may all be the same.
    some = min(width, 2 * tried)
    # Rows and their weights are counted together.
    both = 1 << 26

    def count(batches):
        import pyarrow as pa

        nodes: dict[tuple[int, int], int] = {}
        labels: dict[int, int] = {}
        cells, held = [], 0

        def counted(batch, i, known, wanted):
            label, drawn, bins = _unpacked(batch, i, n_trees)
            names, of = np.unique(label, return_inverse=True)
            codes = np.array([labels.setdefault(int(name), len(labels)) for name in names])
            for tree in wanted:
                for node, rows in _led_down(known.get(tree, {}), drawn[tree].nonzero()[0], bins):
                    if node not in wanted[tree]:
                        continue
                    number = nodes.setdefault((tree, node), len(nodes))
                    chosen = _features_of(tree, node, width, 2 * tried, seed)
                    cell = bins[rows[:, None], chosen].astype(np.int64) + np.arange(some) * (BINS + 1)
                    cell = cell * len(names) + of[rows, None]
                    weight = np.repeat(drawn[tree, rows].astype(float) * both + 1.0, some)
                    n = np.bincount(cell.ravel(), weight)
                    used = n.nonzero()[0]
                    place, name = np.divmod(used, len(names))
                    yield (number * (some * (BINS + 1)) + place << 20) + codes[name], n[used]

        def table(cell, n):
            order = np.array(list(labels), dtype=np.int32)
            at = list(nodes)
            rest, label = cell >> 20, cell & ((1 << 20) - 1)
            node, rest = np.divmod(rest, some * (BINS + 1))
            feature, place = np.divmod(rest, BINS + 1)
            features = np.stack([_features_of(t, v, width, 2 * tried, seed) for t, v in at])
            weight, rows = np.divmod(n, both)
            columns = {
                "tree": (np.array([t for t, _ in at])[node], pa.int32()), "node": (np.array([v for _, v in at])[node], pa.int64()),
                "feature": (features[node, feature], pa.int32()), "bin": (place, pa.int32()), "label": (order[label], pa.int32()),
                "n": (weight, pa.float64()), "m": (rows, pa.float64()),
            }
            return pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in columns.values()], list(columns))

        def added():
            cell, at = np.unique(np.concatenate([c for c, _ in cells]), return_inverse=True)
            return cell, np.bincount(at.ravel(), np.concatenate([n for _, n in cells]))

        for batch in batches:
            if not len(batch):
                continue
            known, wanted = _nodes_of(batch), {}
            for tree, node in _in_order(batch, "large", ["tree", "node"]):
                wanted.setdefault(tree, set()).add(node)
            for i in range(len(batch)):
                for cell in counted(batch, i, known, wanted):
                    cells.append(cell)
                    held += len(cell[0])
                    # Cells are added up before they are handed on.
                    if held >= COUNT_CELLS:
                        cells = [added()]
                        held = len(cells[0][0])
                        if held > COUNT_CELLS // 2:
                            yield table(*cells[0])
                            cells, held = [], 0
        if cells:
            yield table(*added())

    counts = _with_splits(blocks.select("label", "drawn", "bins"), splits, large=large).mapInArrow(
        count, "tree int, node bigint, feature int, bin int, label int, n double, m double"
    )
    counts = counts.groupBy("tree", "node", "feature", "bin", "label").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))

    def best(key, table):
        import pyarrow as pa

        column = {c: table.column(c).to_numpy() for c in ("feature", "bin", "label", "n", "m")}
        features, of = np.unique(column["feature"], return_inverse=True)
        names, label = np.unique(column["label"], return_inverse=True)
        cells, rows = np.zeros((len(features), BINS + 1, len(names))), np.zeros((len(features), BINS + 1))
        cells[of, column["bin"], label] = column["n"]
        np.add.at(rows, (of, column["bin"]), column["m"])
        below = cells.cumsum(axis=1)
        root = float(impurity(below[0, -1]))
        cost = impurity(below) + impurity(below[:, -1:] - below)
        # Between bins that hold rows.
        cost[(rows == 0) | (rows.cumsum(axis=1) == rows.sum(axis=1)[:, None])] = np.inf
        at = cost.argmin(axis=1)
        gains = root - cost[np.arange(len(features)), at]
        k = int(gains.argmax())
        found = dict(feature=None, bin=None, at=None, decrease=0.0, root=root, low_rows=0, high_rows=0)
        if gains[k] > -np.inf:
            f, b = int(features[k]), int(at[k])
            low = int(rows[k, : b + 1].sum())
            found |= dict(feature=f, bin=b, at=float(edges[f][b]), decrease=float(gains[k]), low_rows=low, high_rows=int(rows[k].sum()) - low)
        schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("at", pa.float64()),
                            ("decrease", pa.float64()), ("root", pa.float64()), ("low_rows", pa.int64()), ("high_rows", pa.int64())])
        return pa.table({"tree": [key[0].as_py()], "node": [key[1].as_py()], **{c: [v] for c, v in found.items()}}, schema)

    return counts.groupBy("tree", "node").applyInArrow(best, _SPLIT)


#: What ``_split_level`` finds.
_SPLIT = "tree int, node bigint, feature int, bin int, at double, decrease double, root double, low_rows bigint, high_rows bigint"


def grow_forest(
    rows: DataFrame, width: int, n_trees: int = 200, seed: int = 42, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(tree, root, decreases, left_over) of a forest over rows (id, x, label): the impurity of
    the root, how much of it the splits by each of the ``width`` features take, and what the
    leaves keep because their rows are equal."""
    tried = max(1, int(width**0.5))
    edges: list[list[float]] = []
    # A tree draws about 0.63 of the rows; leave room for chance.
    if 0.7 * rows.count() + 100 > group_rows:
        spread = rows.select(*[F.col("x")[k].alias(f"f{k}") for k in range(width)])
        cuts = spread.approxQuantile(spread.columns, [k / BINS for k in range(1, BINS)], 0.002)
        edges = [sorted(set(c)) for c in cuts]
    blocks = staged(_blocks(rows, edges, n_trees, seed))

    def sizes(batches):
        import pyarrow as pa

        total = np.zeros(n_trees, dtype=np.int64)
        for batch in batches:
            for i in range(len(batch)):
                total += (_unpacked(batch, i, n_trees)[1] > 0).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_trees, dtype=np.int32)), pa.array(total)], ["tree", "n"])

    # One row per node of more than ``group_rows`` rows.
    low, high = (F.xxhash64("node", F.lit(side)).alias(name) for side, name in enumerate(("low", "high")))
    splits = blocks.sparkSession.createDataFrame([], _SPLIT).select("*", low, high, F.lit(0).alias("level"))
    level = 0
    if edges:
        drawn = blocks.select("label", "drawn", "bins").mapInArrow(sizes, "tree int, n bigint").groupBy("tree").agg(F.sum("n").alias("n"))
        large = staged(drawn.where(F.col("n") > group_rows).select("tree", F.lit(0).cast("bigint").alias("node")))
        while not large.isEmpty():
            level += 1
            found = _split_level(blocks, splits, large, edges, n_trees, tried, seed)
            splits = staged(splits.unionByName(found.select("*", low, high, F.lit(level).alias("level"))))
            last = splits.where((F.col("level") == level) & F.col("feature").isNotNull())
            sides = [last.select("tree", F.col(s).alias("node"), F.col(f"{s}_rows").alias("n")) for s in ("low", "high")]
            large = sides[0].union(sides[1]).where(F.col("n") > group_rows).select("tree", "node")

    def parts(batches):
        import pyarrow as pa

        names = ["tree", "node", "x", "label", "weight"]
        for batch in batches:
            known = _nodes_of(batch) if len(batch) else {}
            for i in range(len(batch)):
                label, drawn, bins = _unpacked(batch, i, n_trees)
                x = np.ascontiguousarray(np.frombuffer(batch.column("x")[i].as_buffer()).reshape(len(label), width).T)
                for tree in range(n_trees):
                    found = list(_led_down(known.get(tree, {}), drawn[tree].nonzero()[0], bins))
                    if not found:
                        continue
                    # Values of a feature lie together and pack well.
                    blobs = [[v.tobytes() for v in (x[:, at], label[at], drawn[tree, at])] for _, at in found]
                    columns = [pa.array(c, pa.binary()) for c in zip(*blobs)]
                    nodes = pa.array([node for node, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(found), pa.int32()), nodes, *columns], names)

    def finish(key, table):
        import pyarrow as pa

        tree, node = (k.as_py() for k in key)
        part = lambda name, kind: [np.frombuffer(v.as_buffer(), dtype=kind) for v in table.column(name)]
        x = np.concatenate([v.reshape(width, -1) for v in part("x", float)], axis=1).T
        label, weight = np.concatenate(part("label", np.int32)), np.concatenate(part("weight", np.uint8))
        rng = np.random.default_rng([seed, tree, node & ((1 << 63) - 1)])
        decrease, root, left_over = grow(x, label, weight.astype(float), rng, tried)
        found = {"tree": [tree], "root": [root if node == 0 else 0.0], "decreases": [decrease], "left_over": [left_over]}
        return pa.table(found, pa.schema([("tree", pa.int32()), ("root", pa.float64()),
                                          ("decreases", pa.list_(pa.float64())), ("left_over", pa.float64())]))

    # A node that bins cannot split keeps its impurity; the others are finished.
    whole = _with_splits(blocks, splits).mapInArrow(parts, "tree int, node bigint, x binary, label binary, weight binary")
    done = whole.groupBy("tree", "node").applyInArrow(
        finish, "tree int, root double, decreases array<double>, left_over double"
    )
    one = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k == F.col("feature"), F.col("decrease")).otherwise(0.0)
    )
    done = done.unionByName(
        splits.select(
            "tree",
            F.when(F.col("node") == 0, F.col("root")).otherwise(0.0).alias("root"),
            one.alias("decreases"),
            F.when(F.col("feature").isNull(), F.col("root")).otherwise(0.0).alias("left_over"),
        )
    )
    added = F.array(*[F.sum(F.col("decreases")[k]) for k in range(width)])
    return staged(done).groupBy("tree").agg(
        F.sum("root").alias("root"), added.alias("decreases"), F.sum("left_over").alias("left_over")
    )


def importances(forest: DataFrame, names: list[str]) -> DataFrame:
    """(feature, importance): the share of each feature in what the splits of a tree take, averaged
    over the trees that have a split, and scaled to sum to one."""
    total = F.aggregate("decreases", F.lit(0.0), lambda a, b: a + b)
    entries = F.posexplode(F.transform("decreases", lambda d: F.try_divide(d, F.col("total")))).alias("k", "share")
    shares = forest.withColumn("total", total).select(entries)
    mean = shares.groupBy("k").agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("mean"))
    labels = F.array(*[F.lit(n) for n in names])
    # One row per feature.
    scaled = F.coalesce(F.try_divide("mean", F.sum("mean").over(Window.partitionBy())), F.lit(0.0))
    return mean.select(F.get(labels, F.col("k")).alias("feature"), scaled.alias("importance"))


def cluster_forest(
    matrix: DataFrame, labels: DataFrame, n_trees: int = 200, seed: int = 42, group_rows: int = GROUP_ROWS
) -> tuple[DataFrame, list[str]]:
    """The trees that predict the cluster from the imputed features, and the names of these.
    Noise users take no part."""
    kept = labels.where(F.col("cluster") != -1).select("userid", F.col("cluster").cast("int").alias("label"))
    users = matrix.join(kept.select("userid"), "userid", "left_semi")
    imputed, names = median_impute(users)
    rows = assemble(imputed, names).join(kept, "userid")
    rows = staged(rows.select(F.col("userid").alias("id"), vector_to_array("features").alias("x"), "label"))
    return grow_forest(rows, len(names), n_trees, seed, group_rows), names


def feature_importance(
    matrix: DataFrame, labels: DataFrame, n_trees: int = 200, seed: int = 42, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(feature, importance), strongest first, of a random forest that predicts the cluster."""
    return importances(*cluster_forest(matrix, labels, n_trees, seed, group_rows)).orderBy(F.desc("importance"), "feature")


def top_importances(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
