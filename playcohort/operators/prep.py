"""Preprocessing and linear reduction of a feature matrix.

Fitting returns models whose size depends on the number of columns only; applying them is
a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import (
    PCA,
    ElementwiseProduct,
    PCAModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from playcohort.functions.columns import numeric_columns, unpivot_numeric
from playcohort.functions.quantiles import exact_quantiles
from playcohort.schemas import DEMOGRAPHICS


def select_features(matrix: DataFrame, id_col: str = "userid") -> list[str]:
    """Names of the clustering features: numeric columns, demographics left out."""
    return numeric_columns(matrix, exclude=[*DEMOGRAPHICS, id_col])


@dataclass(frozen=True)
class Moments:
    rows: int
    mean: dict[str, float | None]
    std: dict[str, float | None]

    def scaled(self, column: str) -> Column:
        """Centred and divided by the population deviation; 0 for a constant column."""
        if not self.std[column]:
            return F.lit(0.0)
        return (F.col(column) - F.lit(self.mean[column])) / F.lit(self.std[column])


def fit_moments(df: DataFrame, columns: list[str]) -> Moments:
    aggs = ["count(1) AS rows"]
    for i, c in enumerate(columns):
        x = f"CAST(`{c}` AS DOUBLE)"
        aggs.append(f"avg({x}) AS m{i}")
        aggs.append(f"if(min({x}) = max({x}), 0.0D, stddev_pop({x})) AS s{i}")
    row = df.selectExpr(*aggs).first()
    numbered = list(enumerate(columns))
    return Moments(
        row["rows"], {c: row[f"m{i}"] for i, c in numbered}, {c: row[f"s{i}"] for i, c in numbered}
    )


def fit_medians(matrix: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median per column. Columns without any value are absent."""
    long = unpivot_numeric(matrix.select(*columns), [], columns)
    rows = exact_quantiles(long, ["feature"], "value", {"median": 0.5}).collect()
    return {r["feature"]: r["median"] for r in rows}


def median_impute(matrix: DataFrame, id_col: str = "userid") -> tuple[DataFrame, list[str]]:
    """The clustering features with nulls replaced by the column median, and their names.

    A column without any value has no median and is dropped, along with its name.
    """
    columns = select_features(matrix, id_col)
    medians = fit_medians(matrix, columns)
    kept = [c for c in columns if c in medians]
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in kept]
    return matrix.select(id_col, *filled), kept


def preprocess(matrix: DataFrame, id_col: str = "userid") -> tuple[DataFrame, list[str]]:
    """Impute and standardise: (id, one scaled column per feature) and the feature names."""
    imputed, names = median_impute(matrix, id_col)
    moments = fit_moments(imputed, names)
    return imputed.select(id_col, *[moments.scaled(c).alias(c) for c in names]), names


def assemble(scaled: DataFrame, names: list[str], id_col: str = "userid") -> DataFrame:
    """(id, features vector)."""
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(scaled)
    return vectors.select(id_col, "features")


def signed_components(pc: np.ndarray) -> np.ndarray:
    """Each axis turned so that its largest loading is positive."""
    top = np.abs(pc).argmax(axis=0)
    signs = np.sign(pc[top, np.arange(pc.shape[1])])
    return pc * np.where(signs == 0, 1.0, signs)


@dataclass(frozen=True)
class Reduction:
    """What a fitted reduction kept."""

    components: int
    explained_variance_ratio: list[float]


def project(vectors: DataFrame, k: int, fitted: PCAModel | None = None) -> DataFrame:
    """Replace ``features`` by its scores on the first ``k`` principal axes.

    The input must be centred. MLlib may return an axis pointing either way; turning its
    largest loading positive makes the scores reproducible.
    """
    model = fitted or PCA(k=k, inputCol="features", outputCol="_pc").fit(vectors)
    axes = model.pc.toArray()
    signs = [float(s) for s in (signed_components(axes) * axes).sum(axis=0)[:k]]
    first = VectorSlicer(inputCol="_pc", outputCol="_first", indices=list(range(k)))
    turn = ElementwiseProduct(
        scalingVec=Vectors.dense([1.0 if s >= 0 else -1.0 for s in signs]),
        inputCol="_first",
        outputCol="_turned",
    )
    others = [c for c in vectors.columns if c != "features"]
    scored = turn.transform(first.transform(model.transform(vectors)))
    return scored.select(*others, F.col("_turned").alias("features"))


def pca_reduce(
    vectors: DataFrame, variance_threshold: float = 0.95
) -> tuple[DataFrame, Reduction]:
    """Scores on the fewest axes whose cumulative variance share exceeds the threshold."""
    d = vector_size(vectors)
    model = PCA(k=d, inputCol="features", outputCol="_pc").fit(vectors)
    shares = [float(v) for v in model.explainedVariance]
    k = min(d, int(np.searchsorted(np.cumsum(shares), variance_threshold, side="right")) + 1)
    return project(vectors, k, model), Reduction(k, shares[:k])


def embed_2d(vectors: DataFrame) -> DataFrame:
    """(id, umap_x, umap_y): scores on the first two principal axes, for a scatter."""
    d = vector_size(vectors)
    others = [c for c in vectors.columns if c != "features"]
    plane = project(vectors, min(2, d)).select(*others, vector_to_array("features").alias("xy"))
    return plane.select(
        *others,
        F.get("xy", F.lit(0)).alias("umap_x"),
        F.coalesce(F.get("xy", F.lit(1)), F.lit(0.0)).alias("umap_y"),
    )


def vector_size(vectors: DataFrame) -> int:
    """Length of the feature vectors."""
    return len(vectors.select("features").first()["features"])
