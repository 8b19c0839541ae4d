"""Per-key results for tables in which a few keys hold most of the rows.

Rows are range-partitioned on the composite (key, order value, row number). Spark draws the cut points as quantiles of a
sample of that composite, so a heavy key is cut into as many partitions as its rows need and no task gets more than its
share. Inside a partition the rows are sorted, one pass turns every run of a key into a partial state, and only a key at a
partition's edge can continue in the next partition. Those boundary states are stitched in partition order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandbin.runtime import shuffle_partitions, stage, unstage

#: Rows of a key that meet their key's row in one task, about; and keys dealt to several tasks, at most, which are broadcast:
#: of a table of r rows no more than MOST_HOT keys can have over r / MOST_HOT rows each, which is then what a task gets.
ROWS_PER_SALT, MOST_HOT = 1_000_000, 100_000
STATE_SCHEMA = "pid int, key string, row_count long, value_count long, distinct_values long, first_value {v}, last_value {v}, max_step double, edge boolean"


def _runs(batches: Iterator[pd.DataFrame], numeric: bool) -> Iterator[pd.DataFrame]:
    """One state per run of equal keys in rows sorted by (key, value with nulls first)."""
    open_run: dict | None = None
    first_of_all = True
    for batch in batches:
        if not len(batch):
            continue
        keys = batch["key"].to_numpy(dtype=object)
        values = batch["value"]
        known = values.notna().to_numpy()
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[at[1:], len(keys)]
        raw = values.to_numpy(dtype=float, na_value=np.nan) if numeric else values.to_numpy(dtype=object)
        new_value = known.copy()
        new_value[1:] &= ~(known[:-1] & (keys[1:] == keys[:-1]) & (raw[1:] == raw[:-1]))
        step = np.zeros(len(keys))
        if numeric and len(keys) > 1:
            joined = known[1:] & known[:-1] & (keys[1:] == keys[:-1])
            step[1:] = np.where(joined, raw[1:] - raw[:-1], 0.0)
        filled = np.add.reduceat(known.astype(np.int64), at)
        distinct = np.add.reduceat(new_value.astype(np.int64), at)
        steps = np.maximum.reduceat(step, at)
        first = ends - filled  # nulls sort first
        pid = int(batch["pid"].iloc[0])
        runs = [
            {
                "pid": pid,
                "key": keys[a],
                "row_count": int(e - a),
                "value_count": int(n),
                "distinct_values": int(d),
                "first_value": values.iloc[f] if n else None,
                "last_value": values.iloc[e - 1] if n else None,
                "max_step": float(s) if numeric and n > 1 else None,
                "edge": False,
            }
            for a, e, n, d, s, f in zip(at, ends, filled, distinct, steps, first)
        ]
        if open_run is not None and open_run["key"] == runs[0]["key"]:
            runs[0] = _joined(open_run, runs[0], numeric)
            open_run = None
        done = ([open_run] if open_run is not None else []) + runs[:-1]
        open_run = runs[-1]
        if first_of_all:
            (done or [open_run])[0]["edge"] = True
            first_of_all = not done
        if done:
            yield pd.DataFrame(done)
    if open_run is not None:
        yield pd.DataFrame([open_run | {"edge": True}])


def _joined(a: dict, b: dict, numeric: bool) -> dict:
    """The state of two adjacent runs of one key."""
    both = a["value_count"] and b["value_count"]
    steps = [s for s in (a["max_step"], b["max_step"]) if s is not None]
    if numeric and both:
        steps.append(float(b["first_value"]) - float(a["last_value"]))
    return {
        "pid": b["pid"],
        "key": b["key"],
        "row_count": a["row_count"] + b["row_count"],
        "value_count": a["value_count"] + b["value_count"],
        "distinct_values": a["distinct_values"] + b["distinct_values"] - int(bool(both) and a["last_value"] == b["first_value"]),
        "first_value": a["first_value"] if a["value_count"] else b["first_value"],
        "last_value": b["last_value"] if b["value_count"] else a["last_value"],
        "max_step": max(steps) if steps else None,
        "edge": a["edge"] or b["edge"],
    }


def key_states(df: DataFrame, key: str, order: str, partitions: int | None = None, scanned: bool = False) -> DataFrame:
    """Partial states, one per (partition, key): at most one row per key plus one per partition.

    Row numbers must be the same if a lost task is repeated, or rows would change partitions. They are in a scan of files
    (``scanned=True`` says that ``df`` is one); other rows, whose order may differ after a shuffle, are staged first.

    ``edge`` marks a partition's first and last key, which alone can lie in other partitions too.

    ``order`` may be numeric or a string. The row number in the composite also cuts a run of rows that agree in key and
    order value.
    """
    kind = df.schema[order].dataType
    numeric = isinstance(kind, T.NumericType)
    value = F.col(f"`{order}`").cast("double") if numeric else F.col(f"`{order}`").cast("string")
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), value.alias("value")).where("key is not null")
    if numeric:
        rows = rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if not scanned:
        rows = stage(rows, "key-rows")
    n = partitions or shuffle_partitions(df.sparkSession)
    ranged = (
        rows.withColumn("row_no", F.monotonically_increasing_id())
        .repartitionByRange(n, F.col("key"), F.col("value"), F.col("row_no"))
        .sortWithinPartitions("key", "value", "row_no")
        .select(F.spark_partition_id().alias("pid"), "key", "value")
    )
    schema = STATE_SCHEMA.format(v="double" if numeric else "string")
    return ranged.mapInPandas(lambda batches: _runs(batches, numeric), schema)


def split_key_summary(df: DataFrame, key: str, order: str, partitions: int | None = None, scanned: bool = False) -> DataFrame:
    """Per key: rows, distinct order values, first and last of them, widest step between neighbours, partitions used.

    Columns: ``key, row_count, distinct_values, first_value, last_value, max_step, pieces``.

    Null keys belong to no key and are left out. Null (and NaN) order values count as rows only. Repeated rows count each
    time in ``row_count`` and once in ``distinct_values``. ``max_step`` is null for strings and for keys with fewer than
    two values. An empty table gives an empty result; other columns, whatever their names, are not read. ``scanned``: see
    :func:`key_states`.
    """
    states = stage(key_states(df, key, order, partitions, scanned), "key-states")
    numeric = dict(states.dtypes)["last_value"] == "double"
    results = ("row_count", "distinct_values", "first_value", "last_value", "max_step")
    inner = states.where("not edge").select("key", *results, F.lit(1).cast("long").alias("pieces"))
    # No more than two states of a partition are stitched; the others are their keys' results.
    in_order = Window.partitionBy("key").orderBy("pid")
    before = F.last(F.when(F.col("value_count") > 0, F.col("last_value")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    stitched = states.where("edge").withColumn("before", before)
    seam = F.col("first_value") - F.col("before") if numeric else F.lit(None).cast("double")
    joined = stitched.groupBy("key").agg(
        F.sum("row_count").alias("row_count"),
        (F.sum("distinct_values") - F.count_if(F.col("before") == F.col("first_value"))).alias("distinct_values"),
        F.min("first_value").alias("first_value"),
        F.max("last_value").alias("last_value"),
        F.max(F.greatest("max_step", seam)).alias("max_step"),
        F.count(F.lit(1)).alias("pieces"),
    )
    return inner.unionByName(joined)


def heavy_keys(df: DataFrame, key: str, order: str, percent: int = 3, partitions: int | None = None, scanned: bool = False) -> DataFrame:
    """Keys that hold at least ``percent`` % of all rows, rows of a null key included in the total.

    Columns: those of :func:`split_key_summary` and ``total_rows``.
    """
    total = df.count()
    return split_key_summary(df, key, order, partitions, scanned).withColumn("total_rows", F.lit(total).cast("long")).where(F.col("row_count") * 100 >= F.col("total_rows") * percent)


def number_rows(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``row_no``: the place of each row among the rows of its key in the given order, from 0.

    As ``row_number`` over a window of the key, but a heavy key is cut into as many partitions as its rows need: numbers are
    first given within each partition, and a key's counts in the partitions before are added. Rows of a null key are left
    out. Rows that agree in key and order have an arbitrary order among them, and may lie in several partitions too. A
    column ``row_no`` of ``df`` is replaced. The rows are staged first, so that a repeated task gives them the same ids.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    cols = [c for c in df.columns if c != "row_no"]
    rows = stage(df.where(F.col(f"`{key}`").isNotNull()).select(*[F.col(f"`{c}`") for c in cols]), "number-rows")
    composite = [F.col(f"`{c}`") for c in (key, *order)] + [F.col("row_id_")]
    ranged = rows.withColumn("row_id_", F.monotonically_increasing_id()).repartitionByRange(n, *composite).sortWithinPartitions(*composite).drop("row_id_")
    kinds = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, count = None, 0
        for b in batches:
            if not len(b):
                continue
            k = b[key].to_numpy(dtype=object)
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            number = np.arange(len(k)) - np.repeat(at, np.diff(np.r_[at, len(k)]))
            if last is not None and k[0] == last:
                number[: at[1] if len(at) > 1 else len(k)] += count
            last, count = k[-1], int(number[-1]) + 1
            yield b.assign(own_no=number.astype(np.int64))

    numbered = stage(ranged.withColumn("pid_", F.spark_partition_id()).mapInPandas(run, f"{kinds}, pid_ int, own_no long"), "numbered")
    unstage(rows)
    counts = numbered.groupBy(key, "pid_").agg(F.max("own_no").alias("n")).withColumn("n", F.col("n") + 1)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("pid_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Only keys that reach a second partition need an offset: no more rows than partitions.
    offsets = counts.select(key, "pid_", before.alias("before")).where("before > 0")
    joined = numbered.join(F.broadcast(offsets), [key, "pid_"], "left")
    return joined.select(*cols, (F.col("own_no") + F.coalesce("before", F.lit(0))).alias("row_no"))


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``per_key``, a table of one row per key, by a column that a few keys may fill.

    A key's rows are dealt to salts by their number, and its row in ``per_key`` goes to each of them. ``how`` is ``inner`` or
    ``left``. The key comes first, then the other columns of both tables, whose names must differ.
    """
    sizes = stage(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_")), "key-sizes")
    seen = sizes.agg(F.sum("n_"), F.max("n_")).first()
    per_salt = max(ROWS_PER_SALT, (seen[0] or 0) // MOST_HOT + 1)
    if (seen[1] or 0) <= per_salt:
        return rows.join(per_key, key, how)
    hot = F.broadcast(sizes.where(F.col("n_") > per_salt).select(key, F.ceil(F.col("n_") / per_salt).cast("int").alias("salts_")))
    others = [c for c in rows.columns if c != key]
    dealt = rows.join(hot, key, "left").withColumn("salt_", F.pmod(F.xxhash64(*others), F.coalesce("salts_", F.lit(1))).cast("int")).drop("salts_")
    copies = per_key.join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce("salts_", F.lit(1)) - 1))).drop("salts_")
    return dealt.join(copies, [key, "salt_"], how).drop("salt_")
