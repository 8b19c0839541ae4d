"""Mix sources to target weights.

The targets form a tree of domains, languages and sources. A node's budget goes to its children by weight; what a child
cannot use, because its documents may be repeated only so often, goes to its siblings first and to the node's own siblings
only when the whole node is exhausted. Each leaf then takes whole epochs of its documents and of the last epoch a prefix by
size in a seeded order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbin.runtime import spread, stage

#: Slices of a leaf's seeded order; sums are formed per slice and only the slice in which a budget ends is sorted.
SLICES = 4096
#: Pairs of source and language that the tree may have.
MOST_LEAVES = 100_000


@dataclass
class Node:
    """A node of the tree. Leaves have ``size`` (of their documents) and ``repeats``; inner nodes have children."""

    name: str
    weight: float
    size: float = 0.0
    repeats: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0
    wanted: float = 0.0

    @property
    def capacity(self) -> float:
        return sum(c.capacity for c in self.children) if self.children else self.size * self.repeats


    def leaves(self, path: tuple[Node, ...] = ()) -> Iterator[tuple[Node, ...]]:
        """Every leaf with the nodes above it, the root left out."""
        for c in self.children:
            yield from c.leaves((*path, c)) if c.children else iter([(*path, c)])


def allot(node: Node, budget: float) -> None:
    """Sets ``budget``, what each node gets, in the whole subtree."""
    node.budget = min(budget, node.capacity)
    left, open_ones = node.budget, list(node.children)
    share = {id(c): 0.0 for c in open_ones}
    while open_ones:
        weight = sum(c.weight for c in open_ones)
        full = [c for c in open_ones if not weight or c.capacity <= left * c.weight / weight]
        if not full:
            share |= {id(c): left * c.weight / weight for c in open_ones}
            break
        for c in full:
            share[id(c)] = c.capacity if c.weight else 0.0
        left -= sum(share[id(c)] for c in full)
        open_ones = [c for c in open_ones if c not in full]
    for c in node.children:
        allot(c, share[id(c)])


def tidy(source: Column) -> Column:
    return F.lower(F.trim(source))


def leaf_sizes(docs: DataFrame, targets: DataFrame, source: str, size: str, split: str | None = None) -> DataFrame:
    """Documents of listed sources: ``source, part, size, <all other columns>`` with tidy source names.

    Null, NaN or negative sizes count as 0. Null and unlisted sources are left out. ``part`` is the column ``split`` as a
    string, null as the empty string.
    """
    part = F.coalesce(F.col(f"`{split}`").cast("string"), F.lit("")) if split else F.lit("")
    sized = F.greatest(F.coalesce(F.nanvl(F.col(f"`{size}`").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    kept = docs.select(tidy(F.col(f"`{source}`")).alias("source"), part.alias("part"), sized.alias("size"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("source", "part", "size")])
    names = [r["source"] for r in targets.select(tidy(F.col("source")).alias("source")).where("source is not null").distinct().collect()]
    return kept.where(F.col("source").isin(names))


def plan(sized: DataFrame, targets: DataFrame, smoothing: float = 1.0) -> Node:
    """The tree domain -> language -> source with budgets; the total is the size of all documents of listed sources.

    ``targets`` (``source, target_share, max_repeats`` and, if the sources have domains, ``domain``) is one row per source
    and comes to the driver, as do the sums by source and language, at most ``MOST_LEAVES``; of a source listed twice the
    shares add, the larger ``max_repeats`` and the first domain count. A source wants its share of the total, spread over its
    languages by their sizes to the power ``smoothing``: 1 keeps the languages' own shares, less lifts the small ones. What a
    leaf cannot fill goes to the other sources of its language and domain, then to the domain's other languages, then to
    other domains.
    """
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("size")).where("size > 0").limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} pairs of source and language")
    domain = F.coalesce(F.col("domain").cast("string"), F.lit("")) if "domain" in targets.columns else F.lit("")
    want = targets.select(tidy(F.col("source")).alias("source"), F.coalesce(F.nanvl(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(0.0)).alias("m"), domain.alias("d"))
    want = want.where("source is not null").groupBy("source").agg(F.sum("w").alias("w"), F.max("m").alias("m"), F.min("d").alias("d"))
    by_source: dict[str, list] = {}
    for r in sorted(sums):
        by_source.setdefault(r["source"], []).append(r)
    tree: dict[str, dict[str, list[Node]]] = {}
    for r in sorted(want.collect()):
        parts = by_source.get(r["source"], [])
        scale = sum(p["size"] ** smoothing for p in parts)
        own = [(p["part"], p["size"], p["size"] ** smoothing / scale) for p in parts] or [("", 0.0, 1.0)]
        for part, size, share in own:
            tree.setdefault(r["d"], {}).setdefault(part, []).append(Node(r["source"], r["w"] * share, size, r["m"]))
    root = Node("", 0.0)
    for name, languages in sorted(tree.items()):
        nodes = [Node(part, sum(s.weight for s in sources), children=sources) for part, sources in sorted(languages.items())]
        root.children.append(Node(name, sum(c.weight for c in nodes), children=nodes))
    root.weight = sum(c.weight for c in root.children)
    total = sum(s["size"] for s in sums)
    allot(root, total * root.weight)
    for path in root.leaves():
        path[-1].wanted = path[-1].weight * total
    return root


def by_source(root: Node) -> dict[str, dict[str, float]]:
    """Weight, size, and what is wanted and budgeted, summed over each source's leaves."""
    out: dict[str, dict[str, float]] = {}
    for *_, leaf in root.leaves():
        sums = out.setdefault(leaf.name, {"weight": 0.0, "stored": 0.0, "wanted": 0.0, "budget": 0.0})
        for name, value in (("weight", leaf.weight), ("stored", leaf.size), ("wanted", leaf.wanted), ("budget", leaf.budget)):
            sums[name] += value
    return out


def shortfalls(root: Node) -> list[str]:
    """Sources whose leaves' budgets are less than what they want, rounding left aside."""
    return sorted(s for s, v in by_source(root).items() if v["budget"] < v["wanted"] * (1 - 1e-12))


def select(sized: DataFrame, root: Node, ident: str, seed: int = 0) -> DataFrame:
    """``source, part, <ident>, size, times``: how often each document is in the mixture (0 left out).

    Whole epochs take every document; of the last epoch those whose sizes, summed in the order of a seeded hash, stay
    within the rest of the leaf's budget. Sums by slice of that order come first, so no leaf is sorted as a whole.
    """
    spark = sized.sparkSession
    rows = [(s.name, p.name, int(s.budget // s.size), float(s.budget % s.size)) for *_, p, s in root.leaves() if s.size > 0]
    leaves = F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["source", "part", "epochs", "rest"]), "source string, part string, epochs long, rest double"))  # one row per leaf
    code = F.xxhash64(F.lit(seed), F.col("source"), F.col("part"), F.col(f"`{ident}`"))
    docs = sized.select("source", "part", F.col(f"`{ident}`").alias("ident"), "size", code.alias("code")).withColumn("slice", F.pmod("code", F.lit(SLICES)))
    docs = docs.join(leaves, ["source", "part"])
    in_order = Window.partitionBy("source", "part").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = docs.groupBy("source", "part", "slice").agg(F.sum("size").alias("own"), F.first("rest").alias("rest"))
    edge = sums.withColumn("upto", F.sum("own").over(in_order)).where(F.col("upto") > F.col("rest"))
    edge = edge.groupBy("source", "part").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("own")).alias("before")), "slice").alias("edge"))
    met = docs.join(F.broadcast(edge), ["source", "part"], "left")  # one row per leaf
    at = F.col("edge.slice")
    whole = met.withColumn("extra", (F.coalesce(F.col("slice") < at, F.lit(True)) & (F.col("rest") > 0)).cast("int"))
    sorted_slice = Window.partitionBy("source", "part").orderBy("code", "ident").rowsBetween(Window.unboundedPreceding, 0)
    cut = whole.where(F.col("slice") == at).withColumn("extra", (F.col("edge.before") + F.sum("size").over(sorted_slice) <= F.col("rest")).cast("int"))
    both = whole.where(at.isNull() | (F.col("slice") != at)).unionByName(cut)
    return both.withColumn("times", F.col("epochs") + F.col("extra")).where("times > 0").select("source", "part", F.col("ident").alias(ident), "size", "times")


def report(chosen: DataFrame, root: Node) -> DataFrame:
    """Per source: ``source, target_share, reached_share, stored, taken, documents, most_repeats, falls_short``."""
    spark = chosen.sparkSession
    short = set(shortfalls(root))
    rows = [(name, float(v["weight"]), float(v["stored"]), name in short) for name, v in sorted(by_source(root).items())]
    want = spark.createDataFrame(rows, "source string, target_share double, stored double, falls_short boolean")
    got = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("taken"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("most_repeats"))
    out = want.join(got, "source", "left").na.fill(0, ["taken", "documents", "most_repeats"])
    return out.withColumn("reached_share", F.coalesce(F.try_divide(F.col("taken"), F.sum("taken").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))  # one row per source


def token_counts(docs: DataFrame, text: str, tokenizer: str) -> DataFrame:
    """``docs`` with ``tokens``, the number of tokens of the text (null: 0) by the tokenizer file at that path.

    The file is read by the driver, which sends it to the executors.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rstrip("/").rsplit("/", 1)[-1]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(name))
        t.encode_special_tokens = True
        for b in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch(b.fillna("").tolist(), add_special_tokens=False)], index=b.index)

    return spread(docs).withColumn("tokens", F.pandas_udf(run, "long")(F.col(f"`{text}`")))


def mixture_report(docs: DataFrame, targets: DataFrame, source: str, size: str, ident: str, split: str | None = None, seed: int = 0, smoothing: float = 1.0) -> DataFrame:
    """The shares reached; ``split`` names the column of languages. An empty table of documents gives shares of 0; an empty list of targets an empty report."""
    sized = stage(leaf_sizes(docs, targets, source, size, split).select("source", "part", "size", F.col(f"`{ident}`")), "mixture")
    root = plan(sized, targets, smoothing)
    return report(select(sized, root, ident, seed), root)
