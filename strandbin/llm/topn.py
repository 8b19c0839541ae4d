"""The N highest-scoring items of every group, by bisection of all groups at once.

Every row has an order-preserving code: its score mapped to a 64-bit integer of the same order, then its identifier. For
each group an interval of codes is kept in which its N-th code lies. A round cuts all intervals at equally spaced
midpoints, counts the rows above each of them in one aggregation (partial sums are formed before the shuffle, so a huge
group costs no task more than any other), and keeps the piece with the N-th code. Pieces shrink to the codes that occur in
them. A group is closed as soon as the rows above a midpoint are exactly the rows it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbin.runtime import stage, unstage

LONG_MIN = -(2**63)
#: A group's rows are dealt to one more salt for each so many of its rows wherever they meet their group.
ROWS_PER_SALT = 200_000
#: Groups of several salts, at most: of a table of r rows no more than so many can have over r / MOST_HOT rows each, which
#: is then what a salt holds. They are broadcast.
MOST_HOT = 100_000


def order_code(score: Column) -> Column:
    """A bigint that sorts as the double does; -0.0 equals 0.0."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def _above(code: Column, lo: Column, hi: Column, ways: int) -> Column:
    """How many of ``ways - 1`` equally spaced midpoints of [lo, hi] the code is above: lo of none, hi of all.

    Differences are exact up to 2^63 and doubles beyond, so the number never falls as the code grows.
    """

    def gap(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_subtract(x, y).cast("double"), x.cast("double") - y.cast("double"))

    return F.floor(gap(code, lo) / gap(hi, lo) * (ways - 1)).cast("int")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in names])


def _each_salt(groups: DataFrame) -> DataFrame:
    """One row for each salt of a group."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def top_n_per_group(df: DataFrame, groups: list[str], score: str, ident: str, n: int, ways: int = 64, unique: bool = False) -> DataFrame:
    """Per group the ``n`` rows of the highest score; of equal scores the smaller identifier comes first.

    Returns the columns ``groups``, ``ident`` and ``score`` (double). ``ident`` is an integer column.

    Rows whose score is null or NaN, or whose identifier is null, take no part. A null in a group column is a value like
    any other. An identifier that a group holds several times counts once, with its highest score (``unique=True`` says that
    this does not occur and saves that shuffle). Groups of up to ``n`` rows come out whole. An empty table gives an empty
    result; other columns are not read.
    """
    g = [f"g{i}" for i in range(len(groups))]
    value = F.col(f"`{score}`").cast("double")
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(groups, g)], value.alias("score"), F.col(f"`{ident}`").cast("bigint").alias("ident")).where("score is not null and not isnan(score) and ident is not null")
    if not unique:
        rows = rows.groupBy(*g, "ident").agg(F.max("score").alias("score"))
    rows = stage(rows.select(*g, "score", "ident", order_code(F.col("score")).alias("s"), F.bitwise_not("ident").alias("t")), "topn-rows")
    sizes = stage(
        rows.groupBy(*g).agg(F.count(F.lit(1)).alias("size"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("t").alias("lo_t"), F.max("t").alias("hi_t")), "topn-sizes"
    )
    total = sizes.agg(F.sum("size")).first()[0] or 0
    per_salt = max(ROWS_PER_SALT, total // MOST_HOT + 1)
    salts = F.ceil(F.col("size") / per_salt).cast("int")
    hot = F.broadcast(sizes.where(F.col("size") > per_salt).select(*g, salts.alias("salts")))
    salt = F.pmod(F.xxhash64("t"), F.coalesce("salts", F.lit(1))).cast("int")
    salted = rows.join(hot, _same(rows, hot, g), "left").select(*[rows[c] for c in g], "score", "ident", "s", "t", salt.alias("salt"))
    state = sizes.where(F.col("size") > n).select(*g, "lo", "hi", "lo_t", "hi_t", F.lit(n).cast("bigint").alias("need"), salts.alias("salts"))
    large = _each_salt(state.select(*g, "salts")).withColumn("large", F.lit(True))
    met = salted.join(large, _same(salted, large, [*g, "salt"]), "left").select(*[salted[c] for c in (*g, "salt")], "score", "ident", "s", "t", F.coalesce("large", F.lit(False)).alias("large"))
    met = stage(met, "topn-met")
    unstage(rows)
    small, whole = met.where("not large"), met.where("large").select(*g, "salt", "score", "ident", "s", "t")
    active = whole.select(*g, "salt", "s", "t")
    cuts: list[DataFrame] = []
    while state.limit(1).count():
        dealt = _each_salt(state)
        met = active.join(dealt, _same(active, dealt, [*g, "salt"])).select(*[active[c] for c in g], "s", "t", "lo", "hi", "lo_t", "hi_t", "need", "salts")
        in_tie = F.col("lo") == F.col("hi")
        met = met.where(F.col("s").between(F.col("lo"), F.col("hi")) & (~in_tie | F.col("t").between(F.col("lo_t"), F.col("hi_t"))))
        slot = F.when(in_tie, _above(F.col("t"), F.col("lo_t"), F.col("hi_t"), ways)).otherwise(_above(F.col("s"), F.col("lo"), F.col("hi"), ways))
        counted = (
            met.withColumn("slot", slot)
            .groupBy(*g, "need", "salts", "slot")
            .agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("t").alias("lo_t"), F.max("t").alias("hi_t"), F.first(in_tie).alias("tie"))
        )
        above = Window.partitionBy(*g).orderBy(F.col("slot").desc())  # at most `ways` rows of a group
        counted = counted.withColumn("upto", F.sum("c").over(above)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
        counted = stage(counted, "topn-state")
        exact = F.col("upto") == F.col("need")
        cuts.append(counted.where(exact).select(*g, "salts", F.col("lo").alias("cut"), F.when(F.col("tie"), F.col("lo_t")).otherwise(F.lit(LONG_MIN)).alias("cut_t")))
        state = counted.where(~exact).select(*g, "lo", "hi", "lo_t", "hi_t", (F.col("need") - F.col("upto") + F.col("c")).alias("need"), "salts")
        if len(cuts) % 2 == 0:  # the rows still in question are a small part of those before
            keep = _each_salt(state)
            left = stage(active.join(keep, _same(active, keep, [*g, "salt"]) & active["s"].between(keep["lo"], keep["hi"]), "left_semi"), "topn-active")
            if len(cuts) > 2:
                unstage(active)
            active = left
    out = small.select(*g, "ident", "score")
    if cuts:
        cut = _each_salt(reduce(DataFrame.unionByName, cuts))
        inside = whole.join(cut, _same(whole, cut, [*g, "salt"])).where((F.col("s") > F.col("cut")) | ((F.col("s") == F.col("cut")) & (F.col("t") >= F.col("cut_t"))))
        out = out.unionByName(inside.select(*[whole[c] for c in g], "ident", "score"))
    return out.select(*[F.col(a).alias(c) for a, c in zip(g, groups)], F.col("ident").alias(ident), F.col("score").alias(score))
