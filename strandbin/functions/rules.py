"""Small expressions: names, intervals, vectors, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper length of each classifier scale but the last, and the scales.
SCALE_LIMITS, SCALES = (750, 3000, 7500, 30000), (500, 1000, 5000, 10000, 50000)


# The suffixes of fragment names (contig, then half and number, number, or "original").
HALF_SUFFIX, OTHER_SUFFIX, ANY_SUFFIX = r"^(.+)\.h[12]\.\d+$", r"^(.+)\.(?:\d+|original)$", r"^(.+)\.(?:h[12]\.\d+|\d+|original)$"


def first_word(header: Column) -> Column:
    return F.split(F.trim(header), r"\s+")[0]


def base_name(fragment: Column) -> Column:
    """A fragment's contig by its name's suffix: .h1.N, .h2.N, .N or .original."""
    half = F.regexp_extract(fragment, HALF_SUFFIX, 1)
    other = F.regexp_extract(fragment, OTHER_SUFFIX, 1)
    return F.when(half != "", half).when(other != "", other).otherwise(fragment)


def pair_group(fragment: Column) -> Column:
    """The greedy reading of the suffix, under which each half of a long contig is a group of its own."""
    base = F.regexp_extract(fragment, ANY_SUFFIX, 1)
    return F.when(base != "", base).otherwise(fragment)


def length_scale(length: Column) -> Column:
    out = F.lit(SCALES[-1])
    for limit, scale in reversed(list(zip(SCALE_LIMITS, SCALES))):
        out = F.when(length <= limit, scale).otherwise(out)
    return out


def gene_family(protein: Column) -> Column:
    return F.element_at(F.split(F.split(protein, r"\s+")[0], ":"), -1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not positive or either is null."""
    return F.coalesce(F.when(b > 0, a.cast("double") / b.cast("double")), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Null for a vector of zeros. The norm is bound to a name first, or else it would be formed again for every place."""
    shared = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))
    return F.when(norm(v) > 0, F.flatten(shared))


def cosine_distance(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def overlap_share(s1: Column, l1: Column, s2: Column, l2: Column) -> Column:
    """Common part of two intervals as a share of the longer."""
    common = F.greatest(F.lit(0), F.least(s1 + l1, s2 + l2) - F.greatest(s1, s2))
    return ratio(common, F.greatest(l1, l2))


def refinement_k(duplicated: Column, contigs: Column) -> Column:
    """Sub-bins to look for: one per duplicated gene, at least 2 (so if unknown), fewer if there are too few contigs."""
    k = F.greatest(F.lit(2), F.coalesce(duplicated, F.lit(2)))
    return F.when(contigs < k, F.greatest(F.lit(2), contigs - 1)).otherwise(k)


def learning_rate(epoch: int, epochs: int, peak: float, warmup: int = 10, start: float = 0.1, end: float = 0.01) -> float:
    """Linear from ``start * peak`` up to ``peak``, then half a cosine down to ``end * peak``."""
    if epoch < warmup:
        return peak * (start + (1 - start) * epoch / warmup)
    if epochs <= warmup:
        return peak
    return peak * (end + (1 - end) * 0.5 * (1 + math.cos(math.pi * (epoch - warmup) / (epochs - warmup))))


def learning_rate_at(epoch: Column, epochs: int, peak: float, warmup: int = 10, start: float = 0.1, end: float = 0.01) -> Column:
    """:func:`learning_rate` of a column."""
    up = start + (1 - start) * epoch / warmup
    down = end + (1 - end) * 0.5 * (1 + F.cos(F.lit(math.pi) * (epoch - warmup) / max(epochs - warmup, 1)))
    return F.lit(peak) * F.when(epoch < warmup, up).otherwise(down if epochs > warmup else F.lit(1.0))
