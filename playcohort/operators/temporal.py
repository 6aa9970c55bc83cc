"""Daily, weekly and yearly rhythm."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from playcohort.functions.columns import DAY_US, entropy_bits, floor_div, ratio, xlog2x
from playcohort.operators.prep import fit_moments, signed_components
from playcohort.operators.sessions import listening_clock
from playcohort.session import staged

HOURS = [f"hour_{h}" for h in range(24)]
DAYS = [f"dow_{d}" for d in range(7)]
MONTHS = [f"month_{m}" for m in range(1, 13)]


def _sum(names: list[str]) -> Column:
    return sum((F.col(n) for n in names[1:]), F.col(names[0]))


def _entropy_of(names: list[str]) -> Column:
    """Entropy over bins that are columns of one row."""
    counts = F.array(*[F.col(n) for n in names])
    terms = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + xlog2x(c))
    used = F.size(F.filter(counts, lambda c: c > 0))
    return entropy_bits(F.col("plays"), terms, used)


def temporal_columns() -> list[Column]:
    """The eight rhythm features as expressions over the listening clock."""
    span_days = floor_div(F.col("last_us") - F.col("first_us"), DAY_US) + 1
    return [
        _entropy_of(HOURS).alias("temporal_hour_entropy"),
        _entropy_of(DAYS).alias("temporal_dow_entropy"),
        _entropy_of(MONTHS).alias("temporal_month_entropy"),
        ratio(_sum(HOURS[6:12]), F.col("plays")).alias("morning_ratio"),
        ratio(_sum(HOURS[18:24]), F.col("plays")).alias("evening_ratio"),
        ratio(_sum(DAYS[5:7]), F.col("plays")).alias("weekend_ratio"),
        F.col("days").alias("listening_days"),
        ratio(F.col("plays"), span_days).alias("avg_daily_plays"),
    ]


def hour_share_columns() -> list[Column]:
    return [ratio(F.col(h), F.col("plays")).alias(h) for h in HOURS]


def hour_profile(plays: DataFrame) -> DataFrame:
    """24 play shares per user."""
    return listening_clock(plays).select("userid", *hour_share_columns())


def stability_columns(clock: DataFrame, components: int = 5) -> list[Column]:
    """Scores of the scaled hour profile on its first principal components.

    Fitting needs one pass for the moments and one for the 24 x 24 covariance; the model
    that reaches the driver is 24 by ``components`` numbers. Scores are then plain
    arithmetic on the hour counts, so they add no join. Fewer users than components: zeros.
    """
    names = [f"temporal_stability_pc{i + 1}" for i in range(components)]
    shares = clock.select("userid", *hour_share_columns())
    moments = fit_moments(shares, HOURS)
    if moments.rows < components:
        return [F.lit(0.0).alias(n) for n in names]
    varying = [h for h in HOURS if moments.std[h]]
    if not varying:
        return [F.lit(0.0).alias(n) for n in names]
    scaled = shares.select(*[moments.scaled(h).alias(h) for h in HOURS])
    vectors = VectorAssembler(inputCols=HOURS, outputCol="features").transform(scaled)
    model = PCA(k=components, inputCol="features", outputCol="pc").fit(vectors.select("features"))
    axes = signed_components(model.pc.toArray())
    out = []
    for i, name in enumerate(names):
        score = F.lit(0.0)
        for j, h in enumerate(HOURS):
            if moments.std[h]:
                share = ratio(F.col(h), F.col("plays"))
                weight = float(axes[j, i]) / moments.std[h]
                score = score + (share - F.lit(moments.mean[h])) * F.lit(weight)
        out.append(score.alias(name))
    return out


def temporal_features(
    plays: DataFrame, pca_components: int = 5, with_stability: bool = True
) -> DataFrame:
    """The rhythm block. The components are fitted on the clock before it is projected, so
    it is staged if they are wanted."""
    clock = listening_clock(plays)
    if with_stability:
        clock = staged(clock)
    extra = stability_columns(clock, pca_components) if with_stability else []
    return clock.select("userid", *temporal_columns(), *extra)
