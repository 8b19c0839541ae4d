"""The k most similar vectors for every vector of a table.

A hierarchical k-means tree indexes all rows. Every row traverses it best bin first, through a priority queue of the nodes
it has seen. How many leaves a row visits is calibrated: for a sample of queries the true neighbours are found by brute
force over all rows, and visits are widened until the leaves visited hold the wanted share of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandbin.operators.tree import BLOCK_ROWS, Tree, block_join, blocks_of, grow, matrix, placed
from strandbin.runtime import stage, unstage

#: Rows whose true neighbours calibrate the visits.
CALIBRATION_QUERIES = 512
#: Share of true neighbours that the visited leaves must hold.
RECALL = 0.999
LEAF_ROWS = 256
#: Around the limits, values formed in floats are formed again in doubles: so much times the squared lengths.
DOUBT = 4e-6


def latest_vectors(df: DataFrame, key: str, vector: str, order: str | None = None) -> DataFrame:
    """Per key the vector of the row with the latest ``order`` (without it, any): ``key, v``. Null keys are left out."""
    at = F.col(f"`{order}`") if order else F.lit(0)
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), at.alias("at"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("key is not null")
    return rows.groupBy("key").agg(F.max(F.struct("at", "v")).alias("r")).select("key", F.col("r.v").alias("v"))


def usable(v: str, width: int) -> F.Column:
    """Not null, of the right length, without null, NaN or infinity."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & (F.size(v) == width) & finite


@F.pandas_udf(T.BinaryType())
def pack(v: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(x, dtype=np.float64).tobytes() for x in v], dtype=object)


@F.pandas_udf(T.BinaryType())
def pack_unit(v: pd.Series) -> pd.Series:
    out = []
    for x in v:
        x = np.asarray(x, dtype=np.float64)
        x = x / np.abs(x).max()
        out.append((x / np.sqrt((x * x).sum())).tobytes())
    return pd.Series(out, dtype=object)


def packed_vectors(vectors: DataFrame, width: int, cosine: bool) -> DataFrame:
    """``key, vec, h``: usable vectors as packed doubles (of length 1 for cosine) and their digest."""
    good = vectors.where(usable("v", width))
    if cosine:
        good = good.where(F.exists("v", lambda x: x != 0))
    vec = pack_unit("v") if cosine else pack("v")
    return good.select("key", vec.alias("vec")).withColumn("h", F.unhex(F.md5("vec")))


@dataclass
class Measure:
    """``cosine``: larger is nearer; otherwise Euclidean distance. ``within``: the worst value that counts, after rounding."""

    cosine: bool
    within: float

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Nearness of all pairs in millionths, larger is nearer."""
        if self.cosine:
            return np.rint(a @ b.T * 1e6).astype(np.int64)
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)
        return -np.rint(np.sqrt(np.maximum(d2, 0.0)) * 1e6).astype(np.int64)

    def near_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As :meth:`near`, of the rows of a with those of b in the same place."""
        if self.cosine:
            return np.rint(np.einsum("ij,ij->i", a, b) * 1e6).astype(np.int64)
        return -np.rint(np.sqrt(((a - b) ** 2).sum(1)) * 1e6).astype(np.int64)

    def rough(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What falls as nearness grows, in floats: off by no more than ``doubt`` times the squared lengths."""
        dots = a @ b.T
        if self.cosine:
            return -dots
        dots *= -2.0
        dots += (a * a).sum(1)[:, None]
        dots += (b * b).sum(1)[None]
        return dots

    def slack(self, rough: np.ndarray) -> np.ndarray:
        """How far beyond a value of :meth:`rough` others round to the same nearness."""
        return np.full_like(rough, 1e-6) if self.cosine else 2.2e-6 * np.sqrt(np.maximum(rough, 0.0)) + 4e-12

    @property
    def limit(self) -> float:
        """The value of :meth:`rough` beyond which no pair counts, half a millionth of rounding included."""
        return -(self.within - 1e-6) if self.cosine else (self.within + 1e-6) ** 2

    @property
    def least(self) -> int:
        return round(self.within * 1e6) * (1 if self.cosine else -1) if math.isfinite(self.within) else -(2**62)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row."""
    n = score.shape[1]
    return np.argpartition(score, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), score.shape)


def best_bins(tree: Tree, x: np.ndarray, visits: int) -> np.ndarray:
    """The first leaves that a best-bin-first traversal reaches for each row (-1 where there are fewer).

    All rows of a batch advance together; each has a priority queue over the nodes it has seen, keyed by the distance to the
    node's centre. A step takes the nearest node of every row's queue; a leaf is a visit, an inner node is replaced by its
    children, whose distances are formed only now.
    """
    visits = min(visits, tree.leaves)
    out = np.full((len(x), visits), -1, dtype=np.int32)
    fan = max(1, max(map(len, tree.children)))
    family = np.full((len(tree.children), fan), -1, dtype=np.int64)
    for i, kids in enumerate(tree.children):
        family[i, : len(kids)] = kids
    centre = tree.centre.astype(np.float32)
    half = 0.5 * (centre * centre).sum(1)
    x32 = x.astype(np.float32)
    queue, nodes = np.full((len(x), 4 * fan), np.inf, dtype=np.float32), np.zeros((len(x), 4 * fan), dtype=np.int64)
    queue[:, 0] = 0.0
    used, seen, rows = np.ones(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(rows):
        slot = queue[rows].argmin(1)
        node = nodes[rows, slot]
        queue[rows, slot] = np.inf
        leaf = tree.leaf_no[node]
        hit = leaf >= 0
        out[rows[hit], seen[rows[hit]]] = leaf[hit]
        seen[rows[hit]] += 1
        inner, kids = rows[~hit], family[node[~hit]]
        if len(inner):
            if used[inner].max() + fan > queue.shape[1]:
                queue = np.concatenate([queue, np.full_like(queue, np.inf)], axis=1)
                nodes = np.concatenate([nodes, np.zeros_like(nodes)], axis=1)
            # Half the squared distance less half the row's own squared length, which is the same for all nodes.
            key = half[kids] - np.matmul(centre[kids], x32[inner][:, :, None])[:, :, 0]
            key[kids < 0] = np.inf
            at = used[inner][:, None] + np.arange(fan)[None]
            queue[inner[:, None], at], nodes[inner[:, None], at] = key, kids
            used[inner] += fan
        rows = rows[seen[rows] < visits]
    return out


def true_neighbours(members: DataFrame, asked: pd.DataFrame, width: int, k: int, measure: Measure) -> pd.DataFrame:
    """By brute force over all members: ``q`` (place in ``asked``), ``leaf`` and ``key`` of the k nearest that count."""
    shared = members.sparkSession.sparkContext.broadcast((asked["key"].to_numpy(), matrix(asked["vec"], width)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, x = shared.value
        for b in batches:
            if not len(b):
                continue
            b = b.sort_values("key", ignore_index=True)
            near = measure.near(x, matrix(b["vec"], width))
            m, place = len(b), {name: i for i, name in enumerate(b["key"])}
            code = near * m + (m - 1 - np.arange(m))[None]
            for i, name in enumerate(names):
                if name in place:
                    code[i, place[name]] = np.iinfo(np.int64).min
                    near[i, place[name]] = np.iinfo(np.int64).min
            at = _best(code, k)
            q = np.repeat(np.arange(len(x)), at.shape[1])
            at = at.ravel()
            good = near[q, at] >= measure.least
            yield pd.DataFrame({"q": q[good].astype(np.int32), "near": near[q, at][good], "key": b["key"].to_numpy()[at[good]], "leaf": b["leaf"].to_numpy()[at[good]]})

    found = members.select("key", "vec", "leaf").mapInPandas(run, "q int, near long, key string, leaf int")
    order = Window.partitionBy("q").orderBy(F.col("near").desc(), "key")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "key", "leaf").toPandas()


def _asked(members: DataFrame, n: int, salt: int) -> pd.DataFrame:
    """A bounded sample of members, by hash order."""
    return members.orderBy(F.xxhash64(F.lit(salt), "key")).select("key", "vec").limit(n).toPandas()


def calibrated_visits(members: DataFrame, tree: Tree, width: int, k: int, measure: Measure, recall: float = RECALL) -> int:
    """Leaves to visit so that they hold ``recall`` of the sampled queries' true neighbours."""
    if tree.leaves == 1:
        return 1
    asked = _asked(members, CALIBRATION_QUERIES, 1)
    truth = true_neighbours(members, asked, width, k, measure)
    if not len(truth):
        # None of the sample has a neighbour that counts, so others are looked for among rows that are near each other: the
        # nearest of any distance take their place.
        truth = true_neighbours(members, asked, width, k, Measure(cosine=measure.cosine, within=-1.0 if measure.cosine else math.inf))
    x, visits = matrix(asked["vec"], width), 16
    while True:
        order = best_bins(tree, x, visits)
        hit = order[truth["q"]] == truth["leaf"].to_numpy()[:, None]
        ranks = np.sort(np.where(hit.any(1), hit.argmax(1), tree.leaves))
        needed = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1
        if needed <= visits or visits >= tree.leaves:
            # Half as many again: the sample shows few of the rare, far leaves.
            return int(min(tree.leaves, needed + max(3, needed // 2)))
        visits *= 4


def nearest(vectors: DataFrame, width: int, k: int, cosine: bool, within: float, recall: float = RECALL) -> DataFrame:
    """For every row of ``vectors`` (``key`` unique, ``v array<double>``) its k nearest others: ``key, other, near, place``.

    ``near`` is the cosine (``cosine=True``: only pairs of at least ``within``) or the Euclidean distance (only of at most
    ``within``), rounded to 6 decimals; of equals the smaller key comes first.

    Vectors that are null, of another width, not finite or, for cosine, all zero are left out. Copies of one vector are
    searched once: only the k + 1 smallest keys of a group of copies can be among anyone's nearest. An empty table gives an
    empty result.
    """
    measure = Measure(cosine, within)
    rows = stage(packed_vectors(vectors, width, cosine), "near-rows")
    copy_no = F.row_number().over(Window.partitionBy("h").orderBy("key"))  # cut to k + 1 before the shuffle as well
    members = rows.withColumn("copy_no", copy_no).where(F.col("copy_no") <= k + 1)
    n = rows.count()
    tree = grow(rows, width, n, LEAF_ROWS)
    members = stage(placed(members.select("key", "vec", "copy_no"), tree, width), "near-members")
    visits = calibrated_visits(members, tree, width, k, measure, recall)
    blocks = blocks_of(members, tree.leaves, BLOCK_ROWS)  # rows visit few leaves, and their vectors may be long
    top = k + 1
    least = measure.least

    def work(held: dict, asked: dict, pairs: list) -> pd.DataFrame:
        # The members of a block are sorted by key, so a smaller place is a smaller key.
        m, found = len(held["x"]), []
        worst = np.full(len(asked["x"]), measure.limit, dtype=np.float64)  # rough value of the top-th row so far
        for _, own, who in pairs:
            y = held["x32"][own]
            for s in range(0, len(who), 512):
                w = who[s : s + 512]
                x = asked["x32"][w]
                doubt = DOUBT * ((x * x).sum(1).max(initial=0.0) + (y * y).sum(1).max(initial=0.0))
                rough = measure.rough(x, y)
                some = np.flatnonzero(rough.min(1) <= worst[w] + doubt)
                if not len(some):
                    continue
                rough = rough[some]
                if len(own) >= top:
                    last = np.partition(rough, top - 1, axis=1)[:, top - 1].astype(np.float64)
                    worst[w[some]] = np.minimum(worst[w[some]], last + doubt + measure.slack(last))
                q, i = np.nonzero(rough <= worst[w[some]][:, None] + doubt)
                q, i = w[some[q]], own[i]
                near = measure.near_pairs(asked["x"][q], held["x"][i])
                good = near >= least
                found.append((q[good], near[good] * m + (m - 1 - i[good])))
        if not found:
            return pd.DataFrame({"rep": [], "other": [], "near": []})
        q, code = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((-code, q))
        q, code = q[order], code[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
        kept = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < top
        q, code = q[kept], code[kept]
        return pd.DataFrame({"rep": asked["key"][q], "other": held["key"][m - 1 - code % m], "near": code // m})

    def visited(t: Tree, x: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        leaf = best_bins(t, x, visits)
        wide = np.zeros((len(x), t.leaves + 1), dtype=bool)  # -1 is the last column
        wide[np.arange(len(x))[:, None], leaf] = True
        return wide[:, :-1]

    queries = members.where("copy_no = 1")
    slim = members.drop("copy_no", "reach")
    found = block_join(slim, queries, tree, blocks, width, visited, work, "rep string, other string, near long")
    of_rep = Window.partitionBy("rep").orderBy(F.col("near").desc(), "other")
    lists = found.withColumn("n", F.row_number().over(of_rep)).where(F.col("n") <= top).drop("n")
    reps = rows.groupBy("h").agg(F.min("key").alias("rep"))
    own = rows.select("key", "h").join(reps, "h").select("key", "rep")
    met = own.join(lists, "rep").where(F.col("key") != F.col("other"))
    of_key = Window.partitionBy("key").orderBy(F.col("near").desc(), "other")
    out = met.withColumn("place", F.row_number().over(of_key)).where(F.col("place") <= k)
    out = stage(out.select("key", "other", (F.abs("near") / 1e6 if not cosine else F.col("near") / 1e6).alias("near"), "place"), "near")
    unstage(rows)
    unstage(members)
    return out


def measured_recall(vectors: DataFrame, width: int, k: int, cosine: bool, within: float) -> DataFrame:
    """Recall of :func:`nearest` against brute force over all rows, for a bounded sample other than the calibration's.

    One row: ``queries, true_neighbours, found, recall``.
    """
    measure = Measure(cosine, within)
    rows = stage(packed_vectors(vectors, width, cosine), "recall-rows").withColumn("leaf", F.lit(0))
    asked = _asked(rows, CALIBRATION_QUERIES, 2)
    truth = true_neighbours(rows, asked, width, k, measure)
    truth["query"] = asked["key"].to_numpy()[truth["q"]] if len(truth) else pd.Series(dtype=object)
    spark = vectors.sparkSession
    wanted = spark.createDataFrame(truth[["query", "key"]].astype(str), "query string, other string")
    got = nearest(vectors, width, k, cosine, within).select(F.col("key").alias("query"), "other", F.lit(1).alias("hit"))
    joined = wanted.join(got, ["query", "other"], "left")
    return joined.agg(F.lit(len(asked)).alias("queries"), F.count(F.lit(1)).alias("true_neighbours"), F.count("hit").alias("found"), F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("recall"))
