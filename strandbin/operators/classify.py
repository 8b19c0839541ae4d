"""Class scores of contigs: decisions on given scores, and a classifier per length scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandbin.functions.dna import CLASSIFIER_ALPHABET, canonical_index
from strandbin.functions.rules import SCALES, length_scale
from strandbin.operators.kmers import MULTI_K, multi_shares
from strandbin.runtime import spread, stage, unstage

CLASSES = ("viral", "plasmid", "prokaryotic", "eukaryotic")
#: A contig is dropped if its bacterial or plasmid score is above this; a eukaryotic score from HIGH is a sure one.
DROP_ABOVE, HIGH = 0.5, 0.95
#: Letters, and sequences, that are handled at once, about.
LETTERS, ROWS = 1_000_000, 256


def predicted_class() -> Column:
    """The class of the largest score; of equals the first in the order of ``CLASSES``."""
    scores = F.array(*CLASSES)
    return F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(scores, F.array_max(scores)).cast("int"))


def is_bacterial() -> Column:
    return (F.col("prokaryotic") > DROP_ABOVE) | (F.col("plasmid") > DROP_ABOVE)


def bacterial_filter(scores: DataFrame, drop_above: float = DROP_ABOVE, fallback: bool = True) -> DataFrame:
    """Contigs that stay; all of them if none would, unless ``fallback`` is off."""
    kept = scores.where(~((F.col("prokaryotic") > drop_above) | (F.col("plasmid") > drop_above)))
    return scores if fallback and not kept.limit(1).count() else kept


def _indices() -> dict[int, np.ndarray]:
    return {k: canonical_index(k, CLASSIFIER_ALPHABET) for k in MULTI_K}


def _width(indices: dict[int, np.ndarray]) -> int:
    return sum(int(index.max()) + 1 for index in indices.values())


def _slices(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Consecutive rows of bounded number and, but for single long sequences, letters."""
    size = b["seq"].str.len().to_numpy(dtype=np.int64)
    group = np.cumsum(size + LETTERS // ROWS) // LETTERS
    edge = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(b) else []
    return (b.iloc[x:y] for x, y in zip(edge, [*edge[1:], len(b)]))


def _features(labelled: DataFrame, seq: str, label: str) -> DataFrame:
    """``scale, label, features``: the shares of canonical k-mers for all of MULTI_K side by side, as a staged sparse vector."""
    rows = labelled.select(F.col(f"`{seq}`").alias("seq"), F.col(label).cast("double").alias("label")).where("seq is not null and label is not null")
    indices = _indices()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _slices(b):
                share = multi_shares(part["seq"].tolist(), indices)
                r, place = np.nonzero(share)
                value, place, ends = share[r, place], place.astype(np.int32), np.searchsorted(r, np.arange(len(part) + 1))
                cut = list(zip(ends, ends[1:]))
                yield pd.DataFrame({"scale": part["scale"].to_numpy(), "label": part["label"].to_numpy(), "places": [place[x:y] for x, y in cut], "freqs": [value[x:y] for x, y in cut]})

    found = spread(rows.select(length_scale(F.length("seq")).alias("scale"), "label", "seq")).mapInPandas(run, "scale int, label double, places array<int>, freqs array<double>")
    # Written as the struct that a sparse vector is in files, so that none is made in Python.
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(_width(indices)).alias("size"), F.col("places").alias("indices"), F.col("freqs").alias("values"))
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT()), T.StructField("scale", T.IntegerType())])
    return stage(found.select("label", sparse.alias("features"), "scale"), "class-features", "scale", schema)


def train_classifiers(labelled: DataFrame, key: str, seq: str, label: str) -> dict[int, LogisticRegressionModel]:
    """A multinomial regression on k-mer shares for each length scale that has two labels or more; labels are class numbers."""
    rows = _features(labelled, seq, label)
    models = {}
    for scale in SCALES:
        part = rows.where(F.col("scale") == scale)
        if part.select("label").distinct().limit(2).count() > 1:
            models[scale] = LogisticRegression(family="multinomial", maxIter=30, regParam=0.01).fit(part)
    unstage(rows)
    return models


def save_classifiers(models: dict[int, LogisticRegressionModel], path: str) -> None:
    for scale, model in models.items():
        model.write().overwrite().save(f"{path}/scale-{scale}")


def load_classifiers(path: str, scales: tuple[int, ...] = SCALES) -> dict[int, LogisticRegressionModel]:
    """The models saved under ``path``; scales without a folder have none."""
    found = {}
    for scale in scales:
        try:
            found[scale] = LogisticRegressionModel.load(f"{path}/scale-{scale}")
        except Exception as e:  # noqa: BLE001
            if "does not exist" not in str(e):
                raise
    if not found:
        raise FileNotFoundError(path)
    return found


def classify(rows: DataFrame, key: str, seq: str, models: dict[int, LogisticRegressionModel]) -> DataFrame:
    """``key, scale, probabilities``; a sequence whose scale has no model goes to the nearest scale that has one.

    One pass over the sequences without a shuffle; the models' coefficients go to the tasks.
    """
    near = {scale: min(models, key=lambda s: abs(SCALES.index(s) - SCALES.index(scale))) for scale in SCALES}
    weights = {s: (m.coefficientMatrix.toArray().T.copy(), m.interceptVector.toArray()) for s, m in models.items()}
    shared = rows.sparkSession.sparkContext.broadcast((_indices(), near, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indices, near, weights = shared.value
        for b in batches:
            for part in _slices(b):
                share, scale = multi_shares(part["seq"].tolist(), indices), part["scale"].to_numpy()
                out = [None] * len(part)
                for s in np.unique(scale):
                    at = np.flatnonzero(scale == s)
                    slope, level = weights[near[int(s)]]
                    margin = share[at] @ slope + level
                    odds = np.exp(margin - margin.max(1, keepdims=True))
                    for i, p in zip(at, odds / odds.sum(1, keepdims=True)):
                        out[i] = p
                yield pd.DataFrame({"key": part["key"].to_numpy(), "scale": scale, "probabilities": out})

    known = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{seq}`").alias("seq")).where("seq is not null")
    found = spread(known.select("key", length_scale(F.length("seq")).alias("scale"), "seq")).mapInPandas(run, f"key {dict(rows.dtypes)[key]}, scale int, probabilities array<double>")
    return found.withColumnRenamed("key", key)


def class_scores(rows: DataFrame, key: str, seq: str, models: dict[int, LogisticRegressionModel]) -> DataFrame:
    """``key`` and a score for each of CLASSES, whose numbers were the labels; 0 for classes that a model has not seen."""
    found = classify(rows, key, seq, models)
    return found.select(key, *[F.coalesce(F.get("probabilities", F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(CLASSES)])
