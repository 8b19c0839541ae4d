"""Expressions over DNA strings and k-mer numbering."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of the letters in the profile's index and in the classifier's.
PROFILE_ALPHABET, CLASSIFIER_ALPHABET = "ATGC", "ACGT"


def reverse_complement(seq: Column) -> Column:
    """Other letters stay where they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def encode(kmer: Column) -> Column:
    """Two bits a letter: A 0, C 1, G 2, T 3. Null if there is another letter."""
    digits = F.transform(F.split(kmer, ""), lambda c: F.instr(F.lit(CLASSIFIER_ALPHABET), c) - 1)
    code = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 4 + d)
    return F.when(kmer.rlike("^[ACGT]+$"), code)


def decode(code: Column, k: int) -> Column:
    """The inverse of :func:`encode` for k-mers."""
    letters = [F.substring(F.lit(CLASSIFIER_ALPHABET), (F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)]
    return F.concat(*letters)


def only_bases(seq: Column) -> Column:
    return ~seq.rlike("[^ACGT]")


def canonical_index(k: int, alphabet: str) -> np.ndarray:
    """For every code of :func:`encode` the index of its canonical k-mer.

    Indices count the pairs of a k-mer and its reverse complement in the order in which the alphabet's words meet them.
    """
    rank = {c: i for i, c in enumerate(CLASSIFIER_ALPHABET)}
    flip = {"A": "T", "C": "G", "G": "C", "T": "A"}
    index = np.full(4**k, -1, dtype=np.int32)
    n = 0
    for word in itertools.product(alphabet, repeat=k):
        code = back = 0
        for c, r in zip(word, reversed(word)):
            code, back = code * 4 + rank[c], back * 4 + rank[flip[r]]
        if index[code] < 0:
            index[code] = index[back] = n
            n += 1
    return index


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of ``width`` letters, no empty last line."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
