import gzip
import struct

import pytest

from strandbin.operators.coverage import depth_intervals
from strandbin.sources.bam import covered_runs, read_bam


def _bam(reads, references):
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(references))
    for name, length in references:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for ref, pos, flag, cigar in reads:
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(k)) for n, k in cigar)
        body = struct.pack("<iiBBHHHiiii", ref, pos, 3, 60, 0, len(cigar), flag, 0, -1, -1, 0) + b"ab\0" + ops
        out += struct.pack("<i", len(body)) + body
    return out


READS = [(0, 10, 0, [(5, "S"), (10, "M"), (2, "D"), (5, "M"), (3, "I"), (2, "N"), (4, "=")]), (1, 0, 16, [(9, "M")]), (-1, -1, 4, []), (0, 0, 1024, [(9, "M")]), (0, 12, 0, [(2, "X")])]


def _members(data, size=40):
    """As the format has it, the stream is cut into gzip members."""
    return b"".join(gzip.compress(data[i : i + size]) for i in range(0, len(data), size))


def test_depth_from_bam(spark, tmp_path):
    for name, reads in (("s1", READS), ("s2", [])):
        (tmp_path / f"{name}.bam").write_bytes(_members(_bam(reads, [("c", 100), ("d", 50)])))
    rows = read_bam(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rows.collect()) == [("s1", "c", 10, 20), ("s1", "c", 12, 14), ("s1", "c", 22, 27), ("s1", "c", 29, 33), ("s1", "d", 0, 9)]
    assert ("s1", "c", 12, 14, 2) in {tuple(r) for r in depth_intervals(rows).collect()}


def test_broken_files(tmp_path):
    import io

    with pytest.raises(ValueError):
        list(covered_runs(io.BytesIO(b"SAM\1" + bytes(20))))
    with pytest.raises(EOFError):
        list(covered_runs(io.BytesIO(_bam(READS, [("c", 100), ("d", 50)])[:-3])))
