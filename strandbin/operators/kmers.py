"""k-mer counts and profiles of sequences.

Counting is one pass over Arrow batches without a shuffle: the letters of a batch become codes, every window's number comes
from k shifted adds, and one bincount gives all rows' counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbin.functions.dna import CLASSIFIER_ALPHABET, PROFILE_ALPHABET, canonical_index
from strandbin.runtime import spread

_CODE = np.full(256, -1, dtype=np.int64)
for _i, _c in enumerate(CLASSIFIER_ALPHABET):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i

#: Added to every bucket of a profile before it is divided by its sum.
PSEUDOCOUNT = 1e-5
MULTI_K = (3, 4, 5, 6, 7)
#: Letters that are handled at once.
LETTERS = 4_000_000


def _slices(seqs: pd.Series) -> Iterator[tuple[int, int]]:
    sizes = seqs.str.len().to_numpy(dtype=np.int64)
    group = np.cumsum(sizes) // LETTERS
    edge = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(seqs) else []
    return zip(edge, [*edge[1:], len(seqs)])


def _codes(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters' codes of all sequences, parted by -1, and each letter's row."""
    raw = "\n".join(seqs).encode("ascii", "replace")
    code = _CODE[np.frombuffer(raw, dtype=np.uint8)]
    sizes = np.array([len(s) + 1 for s in seqs])
    sizes[-1] -= 1
    return code, np.repeat(np.arange(len(seqs)), sizes)


def _windows(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows without other letters, and where they start."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        part = code[i : i + n]
        value = value * 4 + part
        bad |= part < 0
    at = np.flatnonzero(~bad)
    return value[at], at


def _per_row(df: DataFrame, key: str, seq: str, k: int, alphabet: str, pseudocount: float | None) -> DataFrame:
    index = canonical_index(k, alphabet)
    width = int(index.max()) + 1
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = b[b["seq"].notna()]
            for a, e in _slices(known["seq"]):
                part = known.iloc[a:e]
                code, row = _codes(part["seq"].tolist())
                value, at = _windows(code, k)
                counts = np.bincount(row[at] * width + index[value], minlength=len(part) * width).reshape(-1, width)
                if pseudocount is None:
                    out = counts.astype(np.int32)
                else:
                    out = counts + pseudocount
                    out /= counts.sum(1, keepdims=True) + pseudocount * width
                yield pd.DataFrame({"key": part["key"].to_numpy(), "out": list(out)})
            rest = b[b["seq"].isna()]
            if len(rest):
                yield pd.DataFrame({"key": rest["key"].to_numpy(), "out": [None] * len(rest)})

    rows = spread(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{seq}`").alias("seq")))
    name, cell = ("counts", "int") if pseudocount is None else ("profile", "double")
    return rows.mapInPandas(run, f"key {kind}, out array<{cell}>").select(F.col("key").alias(key), F.col("out").alias(name))


def kmer_counts(df: DataFrame, key: str, seq: str, k: int = 4, alphabet: str = PROFILE_ALPHABET) -> DataFrame:
    """``key, counts``: per row the counts of its canonical k-mers, windows with other letters left out.

    Upper and lower case are the same. A null sequence gives null; one shorter than k gives zeros.
    """
    return _per_row(df, key, seq, k, alphabet, None)


def kmer_profiles(df: DataFrame, key: str, seq: str, k: int = 4, pseudocount: float = PSEUDOCOUNT) -> DataFrame:
    """``key, profile``: the counts with ``pseudocount`` added to each, as shares that sum to 1; null for null."""
    return _per_row(df, key, seq, k, PROFILE_ALPHABET, pseudocount)


def kmer_multi(df: DataFrame, key: str, seq: str, ks: tuple[int, ...] = MULTI_K) -> DataFrame:
    """``key, k, places, freqs``: per row and k the non-zero shares of canonical k-mers and their indices, in order.

    A sequence with any other letter, or shorter than k, has none, as the classifier wants it.
    """
    indices = {k: canonical_index(k, CLASSIFIER_ALPHABET) for k in ks}
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["seq"].notna()]
            for a, e in _slices(b["seq"]):
                part = b.iloc[a:e]
                code, row = _codes(part["seq"].tolist())
                dirty = np.array([s.upper().strip("ACGT") != "" for s in part["seq"]])
                for k, index in indices.items():
                    width = int(index.max()) + 1
                    value, at = _windows(code, k)
                    keep = ~dirty[row[at]]
                    cell = row[at][keep] * width + index[value[keep]]
                    if len(part) * width < 4 * len(cell):
                        full = np.bincount(cell, minlength=len(part) * width)
                        place = np.flatnonzero(full)
                        n = full[place]
                    else:
                        place, n = np.unique(cell, return_counts=True)
                    r, place = place // width, place % width
                    total = np.bincount(r, n, minlength=len(part))
                    bounds = np.searchsorted(r, np.arange(len(part) + 1))
                    share = n / total[r]
                    yield pd.DataFrame(
                        {
                            "key": part["key"].to_numpy(),
                            "k": np.int32(k),
                            "places": [place[x:y].astype(np.int32) for x, y in zip(bounds, bounds[1:])],
                            "freqs": [share[x:y] for x, y in zip(bounds, bounds[1:])],
                        }
                    )

    rows = spread(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{seq}`").alias("seq")))
    out = rows.mapInPandas(run, f"key {kind}, k int, places array<int>, freqs array<double>")
    return out.withColumnRenamed("key", key)


def multi_shares(seqs: list[str], indices: dict[int, np.ndarray]) -> np.ndarray:
    """A row for each sequence: its shares of canonical k-mers for every k of ``indices`` side by side.

    Shares are as those of :func:`kmer_multi`, zeros where that has none. ``indices`` has for each k, from small to large, the
    result of ``canonical_index``.
    """
    code, row = _codes(seqs)
    other = np.bincount(row[code < 0], minlength=len(seqs))
    other[:-1] -= 1  # the marks between sequences
    code = np.where((other > 0)[row], -1, code).astype(np.int32)
    out, value, bad = [], np.zeros(len(code) + 1, dtype=np.int32), np.zeros(len(code) + 1, dtype=bool)
    for k in range(1, max(indices) + 1):
        n = max(len(code) - k + 1, 0)
        last = code[k - 1 :]
        value, bad = value[:n] * 4 + last, bad[:n] | (last < 0)
        if k in indices:
            index, good = indices[k], ~bad
            width = int(index.max()) + 1
            counts = np.bincount(row[:n][good] * width + index[value[good]], minlength=len(seqs) * width).reshape(-1, width)
            out.append(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return np.concatenate(out, axis=1)


def kmer_spectrum(df: DataFrame, seq: str, k: int) -> DataFrame:
    """``code, windows``: how often each k-mer (not canonical) occurs in all sequences; one partial sum per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = b["seq"].dropna()
            for a, e in _slices(s):
                value, _ = _windows(_codes(s.iloc[a:e].tolist())[0], k)
                code, n = np.unique(value, return_counts=True)
                yield pd.DataFrame({"code": code, "windows": n})

    return spread(df.select(F.col(f"`{seq}`").alias("seq"))).mapInPandas(run, "code long, windows long").groupBy("code").agg(F.sum("windows").alias("windows"))
