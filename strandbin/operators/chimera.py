"""Test whether the two halves of a contig differ, from distances between fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbin.functions.rules import cosine_distance

PERMUTATIONS, ALPHA = 1000, 0.05
#: Fragments that a half of a contig may have; augmentation gives at most 32.
MOST_FRAGMENTS = 256


def half_distances(fragments: DataFrame) -> DataFrame:
    """``contig, kind, first, second, distance`` from ``contig, half, fragment, v``: all pairs within and between halves.

    The pairs of a contig are as many as its augmented fragments allow (eight in each half by default); more than
    ``MOST_FRAGMENTS`` in a half are an error.
    """
    rows = fragments.where("half in ('h1', 'h2') and v is not null")
    sizes = rows.groupBy("contig", "half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_FRAGMENTS)
    if sizes.limit(1).count():
        raise ValueError(f"a half of a contig has more than {MOST_FRAGMENTS} fragments")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.contig") == F.col("b.contig")) & (F.struct("a.half", "a.fragment") < F.struct("b.half", "b.fragment")))
    kind = F.when(F.col("a.half") == F.col("b.half"), F.col("a.half")).otherwise("between")
    return met.select(F.col("a.contig").alias("contig"), kind.alias("kind"), F.col("a.fragment").alias("first"), F.col("b.fragment").alias("second"), cosine_distance(F.col("a.v"), F.col("b.v")).alias("distance")).where("distance is not null")


def f_statistic(n1: Column, s1: Column, n2: Column, s2: Column, squares: Column) -> Column:
    """One-way analysis of variance of two groups from counts, sums and the sum of all squares; 0 where it has no value."""
    n = n1 + n2
    between = s1 * s1 / n1 + s2 * s2 / n2 - (s1 + s2) * (s1 + s2) / n
    within = squares - s1 * s1 / n1 - s2 * s2 / n2
    return F.when((n1 > 0) & (n2 > 0) & (n > 2) & (within > 1e-12), between / (within / (n - 2))).otherwise(0.0)


def _groups(distances: DataFrame, keys: list[str], inner: Column) -> DataFrame:
    d = F.col("distance")
    return distances.groupBy(*keys).agg(
        F.count_if(inner).alias("n1"), F.sum(F.when(inner, d).otherwise(0.0)).alias("s1"), F.count_if(~inner).alias("n2"), F.sum(F.when(~inner, 0.0 + d).otherwise(0.0)).alias("s2"), F.sum(d * d).alias("squares")
    )


def chimera_statistics(distances: DataFrame) -> DataFrame:
    """``contig, within, between, f``: of contigs with distances of both kinds."""
    g = _groups(distances, ["contig"], F.col("kind") != "between").where("n1 > 0 and n2 > 0")
    return g.select("contig", F.col("n1").alias("within"), F.col("n2").alias("between"), f_statistic(F.col("n1"), F.col("s1"), F.col("n2"), F.col("s2"), F.col("squares")).alias("f"))


def chimera_test(distances: DataFrame, permutations: int = PERMUTATIONS, alpha: float = ALPHA) -> DataFrame:
    """``contig, f, p, is_chimera``: share of permutations whose F is at least the observed.

    A permutation gives the first ``within`` distances in the order of a digest of pair and permutation to the inner group.
    """
    observed = chimera_statistics(distances)
    pair = F.struct(F.concat_ws("|", "first", "second").alias("pair"), "distance")
    held = distances.groupBy("contig").agg(F.collect_list(pair).alias("d")).join(observed, "contig")  # see MOST_FRAGMENTS
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    w, n = F.col("within").cast("int"), F.size("d")
    held = held.withColumn("sum", total(F.transform("d", lambda x: x["distance"]))).withColumn("squares", total(F.transform("d", lambda x: x["distance"] * x["distance"])))

    def drawn(perm: Column) -> Column:
        keyed = F.sort_array(F.transform("d", lambda x: F.struct(F.md5(F.concat_ws("|", x["pair"], perm.cast("string"))).alias("o"), x["distance"].alias("distance"))))
        s1 = total(F.transform(F.slice(keyed, F.lit(1), w), lambda x: x["distance"]))
        return (f_statistic(w, s1, n - w, F.col("sum") - s1, F.col("squares")) >= F.col("f") - 1e-9).cast("int")

    hits = F.aggregate(F.sequence(F.lit(1), F.lit(permutations)), F.lit(0), lambda a, perm: a + drawn(perm))
    share = held.select("contig", "f", (hits / permutations).alias("p"))
    return share.select("contig", "f", "p", (F.col("p") < alpha).alias("is_chimera"))
