"""Exact quantiles whose work is spread over the cluster.

Spark's ``percentile`` keeps every distinct value of a group in one buffer of one task.
Here an approximate pass only brackets each wanted rank; a second pass counts the values
outside the brackets and groups the few inside them. The result is exact, and a group is
reduced to a small share of its rows before any task sees it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_ACCURACY = 10_000
_MARGIN = 3.0 / _ACCURACY


def _bracketed_counts(
    rows: DataFrame, keys: list[str], value: str, probs: list[float], few_groups: bool
) -> DataFrame:
    edges = []
    for p in sorted(probs):
        edges += [max(0.0, p - _MARGIN), min(1.0, p + _MARGIN)]
    rows = rows.where(F.col(value).isNotNull())
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, edges, _ACCURACY).alias("_edges"),
    )
    joined = rows.join(F.broadcast(sketch) if few_groups else sketch, keys)
    v, e = F.col(value), F.col("_edges")
    zone = F.lit(2 * len(probs))
    for i in reversed(range(len(probs))):
        zone = F.when(v < e[2 * i], 2 * i).when(v <= e[2 * i + 1], 2 * i + 1).otherwise(zone)
    # A small group is its own bracket.
    zone = F.when(F.col("_n") <= _ACCURACY, F.lit(1)).otherwise(zone)
    counted = (
        joined.select(*keys, "_n", zone.alias("_zone"), v.alias("_v"))
        .withColumn("_v", F.when(F.col("_zone") % 2 == 1, F.col("_v")))
        .groupBy(*keys, "_zone", "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    )
    w = Window.partitionBy(*keys).orderBy("_zone", "_v")
    return counted.withColumn("_upto", F.sum("_c").over(w))


def _value_at(rank: Column) -> Column:
    """The value at a 0-based rank, out of the rows of one group."""
    hit = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
    return F.max(F.when(hit, F.col("_v")))


def exact_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    few_groups: bool = True,
) -> DataFrame:
    """One row per key group, one linearly interpolated quantile per name in ``probs``.

    ``few_groups`` says that the caller knows a bound on the number of groups (columns of
    a matrix, a counted set of clusters): the bracket table is then broadcast.
    """
    counts = _bracketed_counts(rows, keys, value, list(probs.values()), few_groups)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        aggs.append(_value_at(F.floor(pos)).alias(f"_lo_{name}"))
        aggs.append(_value_at(F.ceil(pos)).alias(f"_hi_{name}"))
    out = counts.groupBy(*keys).agg(F.first("_n").alias("_n"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
        cols.append(
            F.when(lo.isNull() | hi.isNull(), missed)
            .otherwise(lo + (hi - lo) * (pos - F.floor(pos)))
            .alias(name)
        )
    return out.select(*keys, *cols)


def exact_lower_share(
    rows: DataFrame, keys: list[str], value: str, share: float, name: str
) -> DataFrame:
    """Per key group the value at rank ``int(n * share)`` (1-based): keeping the rows up to
    it keeps exactly that many, given distinct values."""
    counts = _bracketed_counts(rows, keys, value, [share], True)
    rank = F.floor(F.col("_n") * F.lit(share)) - 1
    return counts.groupBy(*keys).agg(_value_at(rank).alias(name))
