"""Readers of text tables: alignments (PAF), coverage and class scores; SAM reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbin.operators.classify import predicted_class


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """The seven fields that are used. Comments, blank lines, lines of fewer than 11 fields or with bad numbers are skipped."""
    f = F.split("value", "\t")
    numbers = {"target_length": 6, "target_start": 7, "target_end": 8, "matches": 9, "alignment_length": 10}
    rows = spark.read.text(path).where("value not like '#%' and trim(value) <> ''").where(F.size(f) >= 11)
    cols = [f[0].alias("query"), f[5].alias("target"), *[F.expr(f"try_cast(trim(split(value, '\\t')[{i}]) as int)").alias(n) for n, i in numbers.items()]]
    return rows.select(*cols).na.drop(subset=list(numbers))


def read_coverage_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``contig, coverage``: first and last column of a table without header; of a repeated contig the last row counts.

    Lines with one column or a last column that is no number are skipped. Rows of several files are ordered by file name,
    those of one file as they stand there.
    """
    f = F.split("value", "\t")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = spark.read.text(path).withColumn("row_no", place).where(F.size(f) >= 2)
    rows = rows.select(f[0].alias("contig"), F.expr("try_cast(element_at(split(value, '\\t'), -1) as double)").alias("coverage"), "row_no").where("coverage is not null")
    return rows.groupBy("contig").agg(F.max_by("coverage", "row_no").alias("coverage"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The class score table with header that :func:`write_scores` makes: ``contig`` and a score for each class."""
    schema = "header string, viral_score double, plas_score double, prokar_score double, eukar_score double, predicted_class string"
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    return rows.select(F.col("header").alias("contig"), F.col("viral_score").alias("viral"), F.col("plas_score").alias("plasmid"), F.col("prokar_score").alias("prokaryotic"), F.col("eukar_score").alias("eukaryotic"), "predicted_class")


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores of contigs as tab-separated text with header."""
    names = {"contig": "header", "viral": "viral_score", "plasmid": "plas_score", "prokaryotic": "prokar_score", "eukaryotic": "eukar_score"}
    rows = scores.select(*[F.col(c).alias(n) for c, n in names.items()], predicted_class().alias("predicted_class"))
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_coverage_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``sample, contig, coverage`` of several coverage tables; the sample is the file's name without its ending."""
    parts = [read_coverage_tsv(spark, p).select(F.lit(file_stem(p)).alias("sample"), "contig", "coverage") for p in paths]
    return reduce(DataFrame.unionByName, parts)


def file_stem(path: str) -> str:
    """A file's name without folder, ``.gz`` and the ending before it."""
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").rsplit(".", 1)[0]


def read_sam(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Mapped primary reads of SAM text as covered intervals: ``sample, contig, start, end``, one row per aligned run.

    Unmapped, secondary, failed and duplicate reads (flag bits 4, 256, 512, 1024) are left out; deletions and skips in the
    CIGAR string cover nothing.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '@%'").where(F.size(f) >= 11)
    rows = rows.select(f[1].cast("int").alias("flag"), f[2].alias("contig"), (f[3].cast("int") - 1).alias("pos"), f[5].alias("cigar"))
    rows = rows.where(F.col("flag").bitwiseAND(F.lit(4 | 256 | 512 | 1024)) == 0).where("contig <> '*'")
    size = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("int"))
    op = F.regexp_extract_all("cigar", F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    moves = F.zip_with(size, op, lambda n, o: F.when(o.isin("M", "=", "X", "D", "N"), n).otherwise(0))
    covers = F.zip_with(size, op, lambda n, o: F.when(o.isin("M", "=", "X"), n).otherwise(0))
    runs = F.transform(covers, lambda n, i: F.struct(n.alias("n"), F.aggregate(F.slice(moves, F.lit(1), i), F.lit(0), lambda a, x: a + x).alias("at")))
    out = rows.select("contig", "pos", F.explode(F.filter(runs, lambda r: r["n"] > 0)).alias("r"))
    return out.select(F.lit(sample).alias("sample"), "contig", (F.col("pos") + F.col("r.at")).alias("start"), (F.col("pos") + F.col("r.at") + F.col("r.n")).alias("end"))
