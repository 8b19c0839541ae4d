"""FASTA and FASTQ readers and a FASTA writer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandbin.functions.dna import wrap


def fastq_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """Name (to the first white space), sequence and quality; the quality is null if it is cut short."""
    line = next(lines, None)
    while line is not None:
        line = line.rstrip("\r\n")
        if not line.startswith("@"):
            line = next(lines, None)
            continue
        name, seq, quality = (line[1:].split() or [""])[0], [], []
        line = next(lines, None)
        while line is not None and not line.startswith("+"):
            seq.append(line.strip())
            line = next(lines, None)
        size, have = sum(map(len, seq)), 0
        while line is not None and have < size:
            line = next(lines, None)
            if line is not None:
                quality.append(line.strip())
                have += len(quality[-1])
        line = next(lines, None) if line is not None else None
        yield name, "".join(seq), "".join(quality) if have == size else None


class SequenceSource(DataSource):
    """``spark.read.format("fastq").load(path)``: ``header, seq, quality``; one partition per file, .gz by its name.

    The files are read by the tasks through the local file system, which must be shared by the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "header string, seq string, quality string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"].removeprefix("file://").removeprefix("file:"))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = []
        for p in sorted(glob.glob(self.path)) or [self.path]:
            found += [os.path.join(p, f) for f in sorted(os.listdir(p)) if f[0] not in "._"] if os.path.isdir(p) else [p]
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import gzip

        opener = gzip.open if partition.value.endswith(".gz") else open
        with opener(partition.value, "rt", encoding="utf-8") as lines:
            yield from fastq_records(lines)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SequenceSource)
    return spark.read.format("fastq").load(path)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``header, seq`` from FASTA files on any file system Spark reads.

    Files are split at line starts that begin a record, so large files are read by many tasks and a ">" inside a header
    splits nothing. Files ending in .gz are read whole, by one task each. A file must begin with
    a header, or its first line is taken for one; records of an empty header are left out.
    """
    chunks = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", r"^>+|\r", "")
    first = F.instr(record, "\n")
    header = F.trim(F.when(first > 0, F.substring(record, F.lit(1), first - 1)).otherwise(record))
    seq = F.when(first > 0, F.regexp_replace(F.substring(record, first + 1, F.length(record)), r"\s+", "")).otherwise("")
    return chunks.select(F.regexp_replace(header, "^>+", "").alias("header"), seq.alias("seq")).where("header <> ''")


def write_fasta(rows: DataFrame, path: str, name: str, seq: str, folder_by: str | None = None) -> None:
    """FASTA text with lines of 60 letters; one folder per value of ``folder_by``."""
    text = F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrap(F.col(seq))).alias("value")
    if folder_by:
        rows.select(folder_by, text).write.mode("overwrite").partitionBy(folder_by).text(path)
    else:
        rows.select(text).write.mode("overwrite").text(path)
