"""Depth moments of fragments, kept up to date while alignments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_alignments(spark: SparkSession, path: str, schema: str = "sample string, contig string, start int, end int") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


#: Bases of a position bin.
BIN = 1_024


def covered_bases(alignments: DataFrame, clamped: DataFrame, width: int = BIN) -> DataFrame:
    """``sample, fragment, bases``: bases of reads on each valid fragment so far; divided by its length the mean depth.

    ``clamped`` is a batch table of fragments (``fragment, contig, start, end, valid``). A stream can't be sorted by
    position, so reads and fragments are cut at the edges of bins of ``width`` bases and meet by contig and bin; a read thus
    meets the fragments near it, and a contig's reads lie in as many tasks as it has bins. The state is one number per
    sample and fragment.
    """

    def cut(df: DataFrame, start: str, end: str, *others: str) -> DataFrame:
        bins = F.sequence(F.expr(f"`{start}` div {width}"), F.expr(f"(`{end}` - 1) div {width}"))
        rows = df.where(F.col(end) > F.col(start)).select(*others, "contig", start, end, F.explode(bins).alias("bin"))
        low, high = F.col("bin") * width, (F.col("bin") + 1) * width
        return rows.select(*others, "contig", "bin", F.greatest(F.col(start), low).alias(start), F.least(F.col(end), high).alias(end))

    ranges = cut(clamped.where("valid").select("fragment", "contig", F.col("start").alias("from"), F.col("end").alias("to")), "from", "to", "fragment")
    met = cut(alignments, "start", "end", "sample").join(ranges, ["contig", "bin"]).where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")))
    return met.groupBy("sample", "fragment").agg(F.sum(F.least("end", "to") - F.greatest("start", "from")).alias("bases"))


def reads_so_far(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("sample").agg(F.count(F.lit(1)).alias("reads"))
