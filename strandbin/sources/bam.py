"""Binary alignment files (BAM), after the public specification of the format."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from itertools import batched
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Flag bits of reads that count for no depth: unmapped, secondary, failed, duplicate.
SKIPPED_FLAGS = 4 | 256 | 512 | 1024
#: Runs that are handed to Spark at once.
BATCH = 50_000
#: CIGAR operations in the order of their codes; those that cover and those that move along the reference.
OPERATIONS, COVERS, MOVES = "MIDNSHP=X", set("M=X"), set("MDN=X")


def _exactly(stream: BinaryIO, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise EOFError("the file ends inside a record")
    return data


def header(stream: BinaryIO) -> list[tuple[str, int]]:
    """Names and lengths of the references; leaves the stream at the first read."""
    if _exactly(stream, 4) != b"BAM\1":
        raise ValueError("no BAM file")
    _exactly(stream, struct.unpack("<i", _exactly(stream, 4))[0])
    references = []
    for _ in range(struct.unpack("<i", _exactly(stream, 4))[0]):
        name = _exactly(stream, struct.unpack("<i", _exactly(stream, 4))[0])[:-1].decode()
        references.append((name, struct.unpack("<i", _exactly(stream, 4))[0]))
    return references


def covered_runs(stream: BinaryIO) -> Iterator[tuple[str, int, int]]:
    """Reference, start and end of every aligned run of the reads that count."""
    references = header(stream)
    while size := stream.read(4):
        record = _exactly(stream, struct.unpack("<i", size)[0])
        ref, pos, name_size, _, _, n_ops, flag = struct.unpack_from("<iiBBHHH", record)
        if flag & SKIPPED_FLAGS or ref < 0:
            continue
        for op in struct.unpack_from(f"<{n_ops}I", record, 32 + name_size):
            n, kind = op >> 4, OPERATIONS[op & 15]
            if kind in COVERS and n:
                yield references[ref][0], pos, pos + n
            if kind in MOVES:
                pos += n


class AlignmentSource(DataSource):
    """``spark.read.format("bam").load(path)``: ``sample, contig, start, end``; a task per file.

    The blocks of the file are members of a gzip stream, so a file is decoded as it is read, without an index. The sample is
    the file's name without ``.bam``. The tasks read through the local file system, which must be shared by the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "sample string, contig string, start int, end int"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"].removeprefix("file://").removeprefix("file:"))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.bam")) if os.path.isdir(self.path) else glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator:
        import os

        import pyarrow as pa

        sample = os.path.basename(partition.value).removesuffix(".bam")
        with gzip.open(partition.value, "rb") as stream:
            for runs in batched(covered_runs(stream), BATCH):
                contig, start, end = zip(*runs)
                yield pa.RecordBatch.from_arrays([pa.array([sample] * len(runs)), pa.array(contig), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["sample", "contig", "start", "end"])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(AlignmentSource)
    return spark.read.format("bam").load(path)
