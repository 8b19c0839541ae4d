"""Depth of coverage from alignments, per fragment mean and deviation, and its normalisation.

Depth is never stored per base. Alignment ends become events, which are summed per position first, so that a contig with a
third of all reads has at most one event per position. Running sums over events and fragment ends give depth, its integral
and that of its square at every such position; a fragment's moments are differences between its two ends, found by two
equi-joins instead of a join on overlapping ranges. The running sums are formed inside range partitions of (sample, contig,
position), which cut a contig wherever its positions are many, and stitched in partition order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbin.functions.rules import first_word
from strandbin.operators.skew import join_by_key
from strandbin.runtime import shuffle_partitions, stage


def reads_per_sample(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("sample").agg(F.count(F.lit(1)).alias("reads"))


def map_names(names: DataFrame, name: str, known: DataFrame, contig: str, found_as: str = "contig") -> DataFrame:
    """``name, <found_as>, how``: the known contig that a name stands for.

    Tried in turn: the name itself, what is before its first white space, what is before the last dot. Others: null.
    """
    n = F.col(name)
    tries = {"exact": n, "first word": first_word(n), "before dot": F.regexp_extract(n, r"^(.*)\.[^.]*$", 1)}
    options = names.select(name).distinct().select(name, F.posexplode(F.array(*tries.values())).alias("step", "known_"))
    found = options.join(known.select(F.col(contig).alias("known_")).distinct(), "known_")
    best = found.groupBy(name).agg(F.min_by("known_", "step").alias(found_as), F.min("step").alias("step"))
    how = F.element_at(F.array(*map(F.lit, tries)), F.col("step") + 1)
    return names.select(name).distinct().join(best.select(name, found_as, how.alias("how")), name, "left")


def coverage_of_contigs(contigs: DataFrame, cover: DataFrame) -> DataFrame:
    """``contig, coverage``: for each name in ``contigs`` that of the same name in ``cover`` (``contig, coverage``).

    Otherwise that of a name whose first word it is (of several the smallest), and 0 where there is none.
    """
    named = cover.select(F.col("contig").alias("name"), "coverage")
    options = named.select(F.col("name").alias("contig"), F.lit(0).alias("step"), "name", "coverage").unionByName(named.select(first_word(F.col("name")).alias("contig"), F.lit(1).alias("step"), "name", "coverage"))
    best = options.groupBy("contig").agg(F.min_by("coverage", F.struct("step", "name")).alias("coverage"))
    return contigs.select("contig").join(best, "contig", "left").na.fill(0.0, ["coverage"])


def clamp_fragments(fragments: DataFrame, lengths: DataFrame) -> DataFrame:
    """``fragment, contig, start, end, valid``: intervals cut to their contig.

    Null or negative starts, starts at or past the end, and intervals that are empty after cutting are not valid; they are
    given as [0, 0).
    """
    joined = join_by_key(fragments.select("fragment", "contig", "start_pos", "length"), lengths.select("contig", F.col("length").alias("contig_length")), "contig", "left")
    end = F.least(F.col("start_pos") + F.col("length"), F.col("contig_length"))
    valid = F.coalesce((F.col("start_pos") >= 0) & (F.col("start_pos") < F.col("contig_length")) & (end > F.col("start_pos")) & (F.col("length") > 0), F.lit(False))
    zero = F.lit(0)
    return joined.select("fragment", "contig", F.when(valid, F.col("start_pos")).otherwise(zero).cast("int").alias("start"), F.when(valid, end).otherwise(zero).cast("int").alias("end"), valid.alias("valid"))


def _events(alignments: DataFrame) -> DataFrame:
    """Change of depth by position."""
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
    both = alignments.where(F.col("end") > F.col("start")).select("sample", "contig", F.explode(ends).alias("e"))
    return both.groupBy("sample", "contig", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("change"))


def _sums_within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running sums of the points of one partition, from each contig's first point there.

    ``depth`` after the point; ``s0, s1, s2``: the bases so far, and the sums over them of the depth and of its square.
    """
    names, depth, last, sums = None, 0, 0, np.zeros(3, dtype=np.int64)
    for b in batches:
        if not len(b):
            continue
        sample, contig = b["sample"].to_numpy(dtype=object), b["contig"].to_numpy(dtype=object)
        pos, change = b["pos"].to_numpy(dtype=np.int64), b["change"].to_numpy(dtype=np.int64)
        goes_on = names == (sample[0], contig[0])
        at = np.flatnonzero(np.r_[True, (sample[1:] != sample[:-1]) | (contig[1:] != contig[:-1])])
        size = np.diff(np.r_[at, len(b)])

        def upto(x: np.ndarray, before: int) -> np.ndarray:
            total = np.cumsum(x)
            start = total[at] - x[at]
            start[0] -= before if goes_on else 0  # noqa: B023
            return total - np.repeat(start, size)  # noqa: B023

        now = upto(change, depth)
        step = np.r_[0, np.diff(pos)]
        step[at] = 0
        step[0] = pos[0] - last if goes_on else 0
        before = now - change
        s = [upto(step * before**k, int(sums[k])) for k in range(3)]
        yield pd.DataFrame({"pid": b["pid"], "sample": b["sample"], "contig": b["contig"], "pos": pos, "change": change, "step": step, "depth": now, "s0": s[0], "s1": s[1], "s2": s[2]})
        names, depth, last, sums = (sample[-1], contig[-1]), int(now[-1]), int(pos[-1]), np.array([x[-1] for x in s])


def running_depth(points: DataFrame) -> DataFrame:
    """``sample, contig, pos, start, before, depth, area, square`` of points ``sample, contig, pos, change``, each once.

    ``depth`` is that after the point, ``before`` that since the point before it, at ``start`` (null: there is none). ``area``
    and ``square`` sum the depth and its square over all bases before the point.
    """
    n, by = shuffle_partitions(points.sparkSession), ["sample", "contig"]
    ranged = points.select(*by, F.col("pos").cast("long").alias("pos"), F.col("change").cast("long").alias("change")).repartitionByRange(n, *by, "pos").sortWithinPartitions(*by, "pos")
    schema = "pid int, sample string, contig string, pos long, change long, step long, depth long, s0 long, s1 long, s2 long"
    inside = stage(ranged.withColumn("pid", F.spark_partition_id()).mapInPandas(_sums_within, schema), "depth")
    ends = inside.groupBy("pid", *by).agg(F.min("pos").alias("first"), F.max(F.struct("pos", "depth", "s0", "s1", "s2")).alias("e"))
    in_order = Window.partitionBy(*by).orderBy("pid")  # one row a partition that the contig reaches
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    d, seam = F.col("d"), F.coalesce(F.col("first") - F.col("last"), F.lit(0))
    seams = ends.select("pid", *by, "first", "e", F.coalesce(F.sum("e.depth").over(earlier), F.lit(0)).alias("d"), F.lag("e.pos").over(in_order).alias("last"))
    own_area, own_square = d * F.col("e.s0") + F.col("e.s1"), d * d * F.col("e.s0") + 2 * d * F.col("e.s1") + F.col("e.s2")
    seams = seams.select("pid", *by, "d", "last", (seam * d).alias("area_"), (seam * d * d).alias("square_"), own_area.alias("own_area"), own_square.alias("own_square"))
    upto = lambda c: F.coalesce(F.sum(F.col(f"{c}_") + F.col(f"own_{c}")).over(earlier), F.lit(0)) + F.col(f"{c}_")
    seams = seams.select("pid", *by, "d", "last", upto("area").alias("area_"), upto("square").alias("square_")).where("last is not null")
    met = inside.join(F.broadcast(seams), ["pid", *by], "left").na.fill(0, ["d", "area_", "square_"])  # fewer rows than partitions
    start = F.when(F.col("s0") > 0, F.col("pos") - F.col("step")).otherwise(F.col("last"))
    return met.select(
        *by, "pos", start.alias("start"), (F.col("depth") - F.col("change") + d).alias("before"), (F.col("depth") + d).alias("depth"),
        (F.col("area_") + d * F.col("s0") + F.col("s1")).alias("area"), (F.col("square_") + d * d * F.col("s0") + 2 * d * F.col("s1") + F.col("s2")).alias("square"),
    )


def depth_intervals(alignments: DataFrame) -> DataFrame:
    """``sample, contig, start, end, depth``: maximal runs of one depth above 0."""
    runs = running_depth(_events(alignments).where("change <> 0"))
    return runs.where("before > 0").select("sample", "contig", F.col("start").cast("int").alias("start"), F.col("pos").cast("int").alias("end"), F.col("before").alias("depth"))


def fragment_coverage(alignments: DataFrame, clamped: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """``sample, fragment, mean, std``: depth over all bases of each valid fragment, uncovered ones included.

    ``std`` is that of the population. Fragments that are not valid, or without reads in a sample, have zeros there.
    ``samples`` names the input files.
    """
    each = F.explode(F.array(*[F.lit(s) for s in samples])).alias("sample")
    asked = clamped.select(each, "fragment", "contig", "start", "end", "valid")
    events = _events(alignments)
    places = clamped.where("valid").select("contig", F.explode(F.array("start", "end")).alias("pos")).distinct().select(each, "contig", "pos")
    points = events.unionByName(places.withColumn("change", F.lit(0).cast("long"))).groupBy("sample", "contig", "pos").agg(F.sum("change").alias("change"))
    area = stage(running_depth(points).select("sample", "contig", F.col("pos").cast("int").alias("pos"), "area", "square"), "area")  # met twice
    at = lambda side: area.select("sample", "contig", F.col("pos").alias(side), F.col("area").alias(f"area_{side}"), F.col("square").alias(f"square_{side}"))
    met = asked.join(at("start"), ["sample", "contig", "start"], "left").join(at("end"), ["sample", "contig", "end"], "left")
    n = F.when(F.col("valid"), (F.col("end") - F.col("start")).cast("double"))
    mean = (F.col("area_end") - F.col("area_start")) / n
    var = F.greatest((F.col("square_end") - F.col("square_start")) / n - mean * mean, F.lit(0.0))
    return met.select("sample", "fragment", F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(F.sqrt(var), F.lit(0.0)).alias("std"))


def per_million(coverage: DataFrame, reads: DataFrame) -> DataFrame:
    """Scaled by a sample's reads in millions; zero in a sample without reads. ``reads`` has a row per sample."""
    scale = F.col("reads") / 1e6
    joined = coverage.join(F.broadcast(reads), "sample", "left")  # one row per input file
    return joined.select("sample", "fragment", *[F.coalesce(F.when(scale > 0, F.col(c) / scale), F.lit(0.0)).alias(c) for c in ("mean", "std")])


def pivot_samples(coverage: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """One row per fragment, ``<sample>_coverage`` and ``<sample>_coverage_std``; missing ones are 0."""
    cells = [F.max(F.when(F.col("sample") == s, F.col(c))) for s in samples for c in ("mean", "std")]
    names = [f"{s}_coverage{x}" for s in samples for x in ("", "_std")]
    return coverage.groupBy("fragment").agg(*[F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(cells, names)])


def any_coverage(columns: list[str]) -> Column:
    """Some coverage column is neither null nor zero."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0.0)) != 0 for c in columns])


def log_scaled(coverage: DataFrame) -> DataFrame:
    return coverage.select("sample", "fragment", *[F.log1p(c).alias(c) for c in ("mean", "std")])


def standardised(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Each column minus its mean over its population deviation; a constant column becomes 0.

    The moments are one row, which is joined by broadcast.
    """
    moments = wide.agg(*[F.avg(c).alias(f"{c}_avg") for c in columns], *[F.stddev_pop(c).alias(f"{c}_dev") for c in columns]).first()
    out = {}
    for c in columns:
        avg, dev = moments[f"{c}_avg"], moments[f"{c}_dev"]
        out[c] = (F.col(c) - F.lit(avg)) / F.lit(dev) if dev else F.lit(0.0)
    return wide.withColumns(out)
