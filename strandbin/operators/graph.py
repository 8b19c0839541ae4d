"""Labels, components and spanning forests of graphs kept as tables of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbin.runtime import stage, unstage


def follow(pointers: DataFrame) -> DataFrame:
    """``key, label`` from ``key, to`` (a row that points to itself is a root), by doubling the pointers."""
    now = stage(pointers, "pointers")
    while True:
        ahead = now.select(F.col("key").alias("to"), F.col("to").alias("further"))
        then = stage(now.join(ahead, "to").select("key", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "pointers")
        unstage(now)
        if not then.where("moved").limit(1).count():
            return then.select("key", F.col("to").alias("label"))
        now = then.select("key", "to")


def merge_labels(links: DataFrame) -> DataFrame:
    """``label, root``: the smallest label that a chain of links reaches, for the labels in ``links`` (``a, b``).

    Every round gives each label the smallest root among its neighbours', gives that to all labels of the same root, and
    then looks up the root's own root, so a chain of n labels takes about log n rounds of joins and partial aggregations.
    """
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("label"), F.least("a", "m").alias("root")), "roots")
    while True:
        met = both.join(now.select(F.col("label").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("label")).agg(F.min("r").alias("r"))
        low = now.join(met, "label").select("label", "root", F.least("root", "r").alias("low"))
        trees = low.groupBy("root").agg(F.min("low").alias("low"))
        hung = stage(now.join(trees, "root").select("label", "root", "low"), "low")
        ahead = hung.select(F.col("label").alias("low"), F.col("low").alias("further"))
        then = hung.join(ahead, "low").select("label", F.col("further").alias("next"), (F.col("further") != F.col("root")).alias("moved"))
        then = stage(then.withColumnRenamed("next", "root"), "roots")
        unstage(now)
        unstage(hung)
        if not then.where("moved").limit(1).count():
            return then.select("label", "root")
        now = then.select("label", "root")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``a, b, w``: a minimum spanning forest of the undirected edges ``a, b, w``; of equal weights the smaller names first.

    Every round, each tree takes its lightest edge to another tree, trees so joined become one, and edges inside a tree are
    dropped; the number of trees at least halves. Edges of null weight or from a row to itself are left out.
    """
    clean = edges.where("a <> b and w is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    now = stage(clean.select("a", "b", "w", F.col("a").alias("la"), F.col("b").alias("lb")), "forest-edges")
    chosen: list[DataFrame] = []
    while now.limit(1).count():
        both = now.unionByName(now.select("a", "b", "w", F.col("lb").alias("la"), F.col("la").alias("lb")))
        best = stage(both.groupBy("la").agg(F.min(F.struct("w", "a", "b", "lb")).alias("e")).select("la", "e.*"), "forest-best")
        chosen.append(best.select("a", "b", "w").distinct())
        back = best.select(F.col("la").alias("lb"), F.col("lb").alias("back"))
        mutual = (F.col("back") == F.col("la")) & (F.col("la") < F.col("lb"))
        hooks = best.join(back, "lb").select(F.col("la").alias("key"), F.when(mutual, F.col("la")).otherwise(F.col("lb")).alias("to"))
        labels = follow(hooks)
        left = now.join(labels.select(F.col("key").alias("la"), F.col("label").alias("na")), "la").join(labels.select(F.col("key").alias("lb"), F.col("label").alias("nb")), "lb")
        then = stage(left.where("na <> nb").select("a", "b", "w", F.col("na").alias("la"), F.col("nb").alias("lb")), "forest-edges")
        unstage(now)
        now = then
    return reduce(DataFrame.unionByName, chosen) if chosen else now.select("a", "b", "w")
