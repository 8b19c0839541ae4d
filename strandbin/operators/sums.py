"""Sums of matrices and vectors over a whole table, formed per partition first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums are added in so many lanes before the last addition.
LANES = 64


def matrix_sum(df: DataFrame, shape: tuple[int, int], part: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of ``part(batch)`` (of that shape) over all batches; only the sum comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += part(b)
        yield pd.DataFrame({"m": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [sum(np.frombuffer(m) for m in pdf["m"]).tobytes()]})

    lanes = df.mapInPandas(run, "m binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    level = lanes.groupBy("lane").applyInPandas(add, "m binary").collect()
    return sum((np.frombuffer(r["m"]) for r in level), np.zeros(shape[0] * shape[1])).reshape(shape)


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, n, mean``: the mean vector of each group. Sums per batch come first, so a huge group is no single task."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.array(b[vector].tolist(), dtype=np.float64)
            group = b.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            out = b[keys].iloc[order[edge]].reset_index(drop=True)
            yield out.assign(n=np.diff(np.r_[edge, len(order)]), total=list(np.add.reduceat(x[order], edge, axis=0)))

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    parts = df.select(*keys, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"{schema}, n long, total array<double>")
    cells = parts.select(*keys, "n", F.posexplode("total").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    cell = F.struct("i", (F.col("x") / F.col("n")).alias("x"))
    return cells.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["x"]).alias("mean"))
