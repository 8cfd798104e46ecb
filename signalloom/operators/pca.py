"""Pivoting power rows into a feature matrix, principal components, and their scaling."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.operators.scaling import IDS, fill_cells, safe_range

# More distinct pivot keys than this cannot become columns of a PCA input.
MAX_PIVOT_KEYS = 10_000


def distinct_keys(df: DataFrame, column: str, limit: int = MAX_PIVOT_KEYS) -> list[str]:
    """The distinct values of a small vocabulary column, sorted; too many is an error."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values")
    return sorted(r[0] for r in found)


def prepare_features_for_pca(
    power: DataFrame, keys: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """One row per (SubjectID, EpochID, label), one column per ``Electrode_WaveBand``.

    With ``keys`` the columns are given and no job runs; without, they are found
    first. Missing cells become 0; the label is not touched.
    """
    keyed = power.withColumn("Electrode_WaveBand", F.concat_ws("_", "Electrode", "WaveBand"))
    keys = list(keys) if keys is not None else distinct_keys(keyed, "Electrode_WaveBand")
    wide = keyed.groupBy(*IDS).pivot("Electrode_WaveBand", keys).agg(F.first("Power"))
    return fill_cells(wide, keys), keys


@dataclasses.dataclass(frozen=True)
class FittedPca:
    """All components of one fit; the first ``k`` reach the variance target."""

    model: PCAModel
    k: int
    columns: tuple[str, ...]

    @property
    def signs(self) -> list[float]:
        """What turns each component so that its largest loading is positive."""
        loadings = self.model.pc.toArray()
        largest = np.abs(loadings).argmax(axis=0)
        return [1.0 if v >= 0 else -1.0 for v in loadings[largest, range(loadings.shape[1])]]

    @property
    def explained(self) -> list[float]:
        return [float(v) for v in self.model.explainedVariance]


def components_needed(explained: Sequence[float], target: float) -> int:
    total = 0.0
    for k, share in enumerate(explained, start=1):
        total += share
        if total >= target:
            return k
    raise ValueError(f"all components together explain {total}, less than {target}")


def _assemble(df: DataFrame, cols: Sequence[str], out: str, invalid: str) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=invalid).transform(df)


def fit_pca_model(
    df: DataFrame,
    cols: Sequence[str],
    variance_target: float = 0.95,
    handle_invalid: str = "error",
) -> FittedPca:
    """Fit once with all components and pick ``k``; a smaller fit is a prefix of this one."""
    assembled = _assemble(df, cols, "_features", handle_invalid).select("_features")
    model = PCA(k=len(cols), inputCol="_features", outputCol="_pca").fit(assembled)
    k = components_needed([float(v) for v in model.explainedVariance], variance_target)
    return FittedPca(model, k, tuple(cols))


def apply_pca_model(df: DataFrame, fitted: FittedPca, handle_invalid: str = "error") -> DataFrame:
    """Project (without centring) and keep ids, integer label and ``k`` components."""
    projected = fitted.model.transform(_assemble(df, fitted.columns, "_features", handle_invalid))
    signs = F.array(*[F.lit(v) for v in fitted.signs[: fitted.k]])
    kept = F.zip_with(F.slice(vector_to_array("_pca"), 1, fitted.k), signs, lambda x, y: x * y)
    return projected.select(
        "SubjectID",
        "EpochID",
        F.col("label").cast("int").alias("label"),
        array_to_vector(kept).alias("features"),
    )


def min_max_normalize_post_pca_by_subject(
    df: DataFrame, k: int, feature_col: str = "features", id_col: str = "SubjectID"
) -> DataFrame:
    """Scale every component to [0, 1] within each subject; ``k`` is the fitted number."""
    parts = df.withColumn("_a", F.slice(vector_to_array(feature_col), 1, k))
    # Long form for the statistics: one short plan, however many components there are.
    ranges = (
        parts.select(id_col, F.posexplode("_a").alias("_p", "_x"))
        .groupBy(id_col, "_p").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("_p", "lo", "hi"))).alias("_ranges"))
    )
    scaled = F.zip_with("_a", "_ranges", lambda x, r: (x - r["lo"]) / safe_range(r["lo"], r["hi"]))
    out = [
        array_to_vector(scaled).alias(c) if c == feature_col else F.col(c) for c in df.columns
    ]
    return parts.join(ranges, id_col, "left").select(*out)
