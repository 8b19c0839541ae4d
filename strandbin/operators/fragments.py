"""Fragments of contigs and pairs of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbin.operators.skew import number_rows
from strandbin.runtime import shuffle_partitions, stage

#: Largest overlap of two accepted fragments as a share of the longer; attempts per fragment wanted; length from which a
#: contig is augmented by halves.
MAX_OVERLAP, ATTEMPTS, SPLIT_LENGTH = 0.25, 10, 50_000


def _candidates(length: Column, name: Column, half: str, seed: int, tries: int) -> Column:
    """``(start, length)`` of each attempt: half of them lose both edges, the others the left, the right or the outside of
    a centre, in equal parts. An attempt's three numbers come from one digest of name, half, attempt and seed."""
    digests = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.md5(F.concat_ws("|", name, F.lit(half), i.cast("string"), F.lit(str(seed)))))

    def part(d: Column, at: int) -> Column:
        return F.conv(F.substring(d, at, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    drawn = F.transform(digests, lambda d: F.struct(part(d, 1).alias("a"), part(d, 9).alias("b"), part(d, 17).alias("way")))
    cut = lambda x: F.floor(x * length).cast("int")
    placed = F.transform(drawn, lambda r: F.struct(r["way"].alias("way"), r["b"].alias("b"), cut(F.least(r["a"], r["b"])).alias("left"), cut(F.greatest(r["a"], r["b"])).alias("right"), F.greatest(cut(r["a"]), F.lit(1)).alias("size")))

    def one(r: Column) -> Column:
        outer = F.when(r["way"] < 2 / 3, length - r["size"]).when(r["way"] < 5 / 6, F.lit(0)).otherwise(F.floor((length - r["size"]) * r["b"]))
        both = r["way"] < 1 / 2
        return F.struct(F.when(both, r["left"]).otherwise(outer).cast("int").alias("start"), F.when(both, r["right"] - r["left"]).otherwise(r["size"]).cast("int").alias("length"))

    return F.transform(placed, one)


def _accepted(candidates: Column, least: int, wanted: int, max_overlap: float) -> Column:
    """Greedy, in order: long enough and no more than the overlap with any accepted before; at most ``wanted``."""
    kind = "array<struct<start:int,length:int>>"

    def clashes(x: Column, y: Column) -> Column:
        common = F.greatest(F.lit(0), F.least(x["start"] + x["length"], y["start"] + y["length"]) - F.greatest(x["start"], y["start"]))
        return common >= max_overlap * F.greatest(x["length"], y["length"])

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc) < wanted) & (x["length"] >= least) & ~F.exists(acc, lambda y: clashes(x, y))
        return F.when(fits, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(candidates, F.array().cast(kind), step)


def augment_fragments(contigs: DataFrame, least: int, wanted: int = 8, max_overlap: float = MAX_OVERLAP, split: int = SPLIT_LENGTH, seed: int = 0) -> DataFrame:
    """``contig, kind, half, ordinal, start_pos, length`` from ``contig, length``: each contig itself and its fragments.

    Contigs longer than ``split`` get ``wanted`` fragments in each half. Contigs shorter than ``least``, or of null length,
    have none. No sequence is read.
    """
    # Names and lengths are small, what is computed from them is not: they are dealt to all tasks.
    whole = contigs.where(F.col("length") >= least).select("contig", "length").repartition(shuffle_partitions(contigs.sparkSession), "contig")
    none = F.lit(None).cast("string")
    originals = whole.select("contig", F.lit("original").alias("kind"), none.alias("half"), F.lit(None).cast("int").alias("ordinal"), F.lit(0).alias("start_pos"), F.col("length").cast("int").alias("length"))
    mid = F.expr("cast(length div 2 as int)")
    short = whole.where(F.col("length") <= split).select("contig", none.alias("half"), F.lit(0).alias("at"), F.col("length").cast("int").alias("size"), F.lit("").alias("tag"))
    long_ones = whole.where(F.col("length") > split)
    h1 = long_ones.select("contig", F.lit("h1").alias("half"), F.lit(0).alias("at"), mid.alias("size"), F.lit("h1").alias("tag"))
    h2 = long_ones.select("contig", F.lit("h2").alias("half"), mid.alias("at"), (F.col("length") - mid).cast("int").alias("size"), F.lit("h2").alias("tag"))
    out = originals
    for part, tag in ((short, ""), (h1, "h1"), (h2, "h2")):
        chosen = _accepted(_candidates(F.col("size"), F.col("contig"), tag, seed, ATTEMPTS * wanted), least, wanted, max_overlap)
        rows = part.select("contig", "half", "at", F.posexplode(chosen).alias("ordinal", "f"))
        out = out.unionByName(rows.select("contig", F.lit("aug").alias("kind"), "half", "ordinal", (F.col("at") + F.col("f.start")).alias("start_pos"), F.col("f.length").alias("length")))
    return out


#: Draws of a group that one row stands for before it is exploded.
DRAWS = 65_536


def _numbers(df: DataFrame, number: str, name: str) -> DataFrame:
    """``df`` with a row for each of 0 to ``number`` - 1; rows of 0 are left out."""
    blocks = df.where(F.col(number) > 0).withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1, F.lit(DRAWS).cast("long"))))
    inside = F.sequence(F.col("block_"), F.least(F.col("block_") + F.lit(DRAWS).cast("long"), F.col(number)) - 1)
    return blocks.withColumn(name, F.explode(inside)).drop("block_")


def _quotas(sizes: DataFrame, total: int, cap: int) -> DataFrame:
    """``g, n, pairs, quota``: shares of the cap in proportion to the pairs; quotas sum to the cap, the largest fractions first.

    The groups are ranked by :func:`number_rows`, which cuts one order over all groups into range partitions.
    """
    exact = F.col("pairs").cast("decimal(38,0)") * F.lit(cap).cast("decimal(19,0)")
    shares = sizes.withColumn("quota", F.floor(exact / F.lit(total)).cast("long")).withColumn("rest", (exact % F.lit(total)).cast("long"))
    shares = stage(shares.withColumn("all", F.lit(0)).withColumn("back", -F.col("rest")), "pair-shares")
    left = cap - shares.agg(F.sum("quota")).first()[0]
    ranked = number_rows(shares, "all", ["back", "g"])
    return ranked.select("g", "pairs", (F.col("quota") + (F.col("row_no") < left).cast("long")).alias("quota"))


def positive_pairs(rows: DataFrame, group: str, member: str, cap: int, seed: int = 0) -> DataFrame:
    """``<group>, first, second``: pairs of members of one group; all of them if they are no more than ``cap``.

    Otherwise ``cap`` of them. Each group gets a share of the cap in proportion to its number of pairs, which may be none, and
    draws as many of its numbered pairs without replacement, by a digest of group, draw and ``seed``; of a group that gives
    more than half of its pairs those left out are drawn. So a group of n members costs its share of the cap and not n
    squared. Members are numbered by name within their group; groups of one member have no pairs, repeated rows count once.
    """
    members = rows.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("pairs", F.expr("n * (n - 1) div 2"))
    total = sizes.agg(F.sum("pairs").alias("p")).first()["p"] or 0
    numbered = number_rows(members, "g", ["m"]).select("g", "m", F.col("row_no").alias("i"))
    if total <= cap:
        a, b = numbered.alias("a"), numbered.alias("b")
        return a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.i") < F.col("b.i"))).select(F.col("a.g").alias(group), F.col("a.m").alias("first"), F.col("b.m").alias("second"))
    quotas = stage(_quotas(sizes.select("g", "pairs"), total, cap).where("quota > 0"), "pair-quotas")
    # Twice as many draws as are wanted, of at most half of the pairs: far more distinct ones than needed.
    wanted = quotas.withColumn("drawn", F.least("quota", F.col("pairs") - F.col("quota"))).withColumn("draws", F.when(F.col("drawn") > 0, 2 * F.col("drawn") + 64).otherwise(F.lit(0)))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("g"), F.col("t").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    drawn = _numbers(wanted, "draws", "t").select("g", "drawn", (digest % F.col("pairs")).alias("r"), "t").groupBy("g", "drawn", "r").agg(F.min("t").alias("t"))
    drawn = stage(number_rows(drawn, "g", ["t"]).where("row_no < drawn").select("g", "r"), "pair-draws")
    few = F.col("quota") * 2 <= F.col("pairs")
    kept = drawn.join(quotas.where(few).select("g"), "g", "left_semi")
    rest = _numbers(quotas.where(~few), "pairs", "r").select("g", "r").join(drawn, ["g", "r"], "left_anti")
    # Pair number r is (j, i) with i < j and r = j (j - 1) / 2 + i.
    j = F.floor((1 + F.sqrt(1.0 + 8.0 * F.col("r"))) / 2)
    at = kept.unionByName(rest).withColumn("j", j).withColumn("j", F.when(F.expr("j * (j - 1) div 2 > r"), F.col("j") - 1).when(F.expr("j * (j + 1) div 2 <= r"), F.col("j") + 1).otherwise(F.col("j")).cast("long"))
    at = at.withColumn("i", F.expr("r - j * (j - 1) div 2"))
    first = at.join(numbered.select("g", F.col("i").cast("long").alias("i"), F.col("m").alias("first")), ["g", "i"])
    both = first.join(numbered.select("g", F.col("i").cast("long").alias("j"), F.col("m").alias("second")), ["g", "j"])
    return both.select(F.col("g").alias(group), "first", "second")


def shuffled(pairs: DataFrame, seed: int, *columns: str) -> DataFrame:
    """The rows in the order of a seeded digest of ``columns``, range-partitioned: another order for every seed (epoch)."""
    order = F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))
    return pairs.orderBy(order, *columns)
