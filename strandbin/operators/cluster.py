"""Clustering of contig vectors: neighbours, density cut, two-means filter, splitting of bins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandbin.functions.rules import euclidean, unit
from strandbin.operators.graph import follow, merge_labels
from strandbin.operators.sums import matrix_sum
from strandbin.operators.tree import Tree, block_join, blocks_of, grow, matrix, placed, within_once
from strandbin.runtime import shuffle_partitions, stage, unstage

NOISE = "noise"
LEAF_ROWS = 512
#: Leaves that a row visits to bound the distance of its k-th neighbour.
FIRST_VISITS = 3
#: Farthest rows of a group that are in one task at once while its first centres are chosen; more take more rounds.
FIRST_ROWS = 8_192
#: Rows of a group that share a lane, about.
LANE_ROWS = 8_192
#: Distances that a task holds at once.
CELLS = 2_500_000
#: Around limits, squared distances formed in floats are formed again in doubles: so much times the squared lengths.
DOUBT = 4e-6


@F.pandas_udf(T.BinaryType())
def packed(v: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(x, dtype=np.float64).tobytes() for x in v], dtype=object)


def _sides(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices of floats whose product is the squared distances of all rows, and by how much it may be off."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    one = np.concatenate([-2.0 * x, xx[:, None], np.ones((len(x), 1))], axis=1).astype(np.float32)
    two = np.concatenate([y, np.ones((len(y), 1)), yy[:, None]], axis=1).astype(np.float32)
    return one, two, DOUBT * float(xx.max(initial=0.0) + yy.max(initial=0.0))


def _steps(who: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
    """``who`` in parts of which each, with all of ``own``, makes no more than ``CELLS`` distances."""
    step = max(1, min(512, CELLS // max(len(own), 1)))
    return (who[s : s + step] for s in range(0, len(who), step))


def _top(k: int):
    def work(held: dict, asked: dict, pairs: list) -> pd.DataFrame:
        # Members are sorted by key: of equal distances (in steps of 1e-7) the smaller place is the smaller key.
        m, top, found = len(held["x"]), k + 1, []  # the row itself may be there
        # Beyond this squared distance no row is among a row's nearest; distances are first formed in floats.
        worst = (asked["bound"] + 1e-6) ** 2 if "bound" in asked else np.full(len(asked["x"]), np.inf)
        for _, own, rows in pairs:
            one, two, doubt = _sides(asked["x"][rows], held["x"][own])
            for part in _steps(np.arange(len(rows)), own):
                rough = one[part] @ two.T
                near = np.flatnonzero(rough.min(1) <= worst[rows[part]] + doubt)
                if not len(near):
                    continue
                rough, w = rough[near], rows[part[near]]
                if len(own) >= top:
                    last = np.maximum(np.partition(rough, top - 1, axis=1)[:, top - 1].astype(np.float64) + doubt, 0.0)
                    worst[w] = np.minimum(worst[w], (np.sqrt(last) + 1.1e-7) ** 2)
                for some in _lean(rough, worst[w] + doubt, 64 * top):
                    q, i = np.nonzero(rough[some] <= (worst[w[some]] + doubt)[:, None])
                    q, i = w[some][q], own[i]
                    other = asked["no"][q] != held["no"][i]
                    q, i = q[other], i[other]
                    code = np.rint(np.sqrt(((asked["x"][q] - held["x"][i]) ** 2).sum(1)) * 1e7).astype(np.int64) * m + i
                    found.append(_first(q, code, k))
        q, code = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
        q, code = _first(q, code, k)
        at = code % m if m else code
        exact = np.sqrt(((asked["x"][q] - held["x"][at]) ** 2).sum(1))
        return pd.DataFrame({"key": asked["key"][q], "other": held["key"][at], "distance": exact})

    return work


def _lean(rough: np.ndarray, limit: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of ``rough`` in parts: all at once if few values are within the limits, else (copies) a few rows at a time."""
    rows = np.arange(len(rough))
    if rough.shape[1] <= most or np.count_nonzero(rough <= limit[:, None]) <= most * len(rough):
        return [rows]
    return np.array_split(rows, -(-rough.size // (CELLS // 16)))


def _first(q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each q the k smallest codes."""
    order = np.lexsort((code, q))
    q, code = q[order], code[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    kept = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k
    return q[kept], code[kept]


def neighbours(vectors: DataFrame, width: int, k: int) -> DataFrame:
    """``key, other, distance, place``: the exact k nearest others of every row of ``key, v``, by Euclidean distance.

    A visit of the nearest leaves of a tree bounds the distance of a row's k-th neighbour; a second join visits the leaves
    that the bounds of the tree cannot exclude at that distance. Null vectors are left out; of distances that agree in 7
    decimals the smaller key comes first.
    """
    rows = stage(vectors.where("key is not null and v is not null").select("key", packed("v").alias("vec")), "near-rows")
    n = rows.count()
    tree = grow(rows, width, n, LEAF_ROWS)
    members = stage(placed(rows.withColumn("no", F.xxhash64("key")), tree, width), "near-members")
    blocks = blocks_of(members, tree.leaves)
    balls = tree.balls(blocks.radius)
    slim = members.drop("reach")
    order = Window.partitionBy("key").orderBy(F.round("distance", 7), "other")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    schema = "key string, other string, distance double"
    first = best(block_join(slim, slim, tree, blocks, width, lambda t, x, _: t.nearest_leaves(x, FIRST_VISITS), _top(k), schema))
    bound = first.groupBy("key").agg(F.max(F.when(F.col("place") == k, F.col("distance"))).alias("bound"))
    asked = stage(slim.join(bound, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "near-bound")

    def visited(t, x, part):  # noqa: ANN001, ANN202
        return t.reached(x, part["bound"].to_numpy() + 1e-6, balls)

    return best(block_join(asked, asked, tree, blocks, width, visited, _top(k), schema))


def core_distances(near: DataFrame, k: int) -> DataFrame:
    """``key, core``: distance to the k-th neighbour, the row itself not counted."""
    return near.where(F.col("place") == k).select("key", F.col("distance").alias("core"))


def mutual_reachability(near: DataFrame, core: DataFrame) -> DataFrame:
    """``a, b, w`` with a < b over the neighbour pairs: the largest of their distance and both core distances."""
    pairs = near.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("d"))
    ca, cb = core.select(F.col("key").alias("a"), F.col("core").alias("ca")), core.select(F.col("key").alias("b"), F.col("core").alias("cb"))
    return pairs.join(ca, "a").join(cb, "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w"))


def density_cut(edges: DataFrame, keys: DataFrame, epsilon: float, least: int) -> DataFrame:
    """``key, cluster``: what edges of at most ``epsilon`` join; groups of fewer than ``least`` rows are noise.

    A cluster is named by its smallest key.
    """
    links = edges.where(F.col("w") <= epsilon).select("a", "b")
    roots = merge_labels(links)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    named = roots.join(sizes, "root").select(F.col("label").alias("key"), F.when(F.col("n") >= least, F.col("root")).alias("cluster"))
    return keys.select("key").join(named, "key", "left").select("key", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def _one_of_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows ``key, vec, ..`` the smallest key's of each vector, and ``rep, key`` for all rows."""
    reps = stage(rows.join(rows.groupBy("vec").agg(F.min("key").alias("rep")), "vec"), "copies")
    return reps.where("key = rep").drop("rep"), reps.select("rep", "key")


def close_links(vectors: DataFrame, near: DataFrame, width: int, core_k: int, epsilon: float) -> DataFrame:
    """``a, b, w``: links of weight 0 that join what the whole mutual reachability graph, cut at ``epsilon``, joins.

    ``near`` is the result of :func:`neighbours` of ``vectors``. Its edges join most rows; an exact join of the rows whose
    core distance is at most ``epsilon`` (copies are one row) then finds which of the labels so far have a pair within it.
    """
    core = core_distances(near, core_k).where(F.col("core") <= epsilon)
    dense = vectors.where("key is not null and v is not null").select("key", packed("v").alias("vec")).join(core.select("key"), "key")
    reps, copies = _one_of_copies(dense)
    links = mutual_reachability(near, core).where(F.col("w") <= epsilon).select("a", "b")
    links = links.unionByName(copies.where("rep <> key").select(F.col("rep").alias("a"), F.col("key").alias("b")))
    roots = merge_labels(links).select(F.col("label").alias("key"), "root")
    known = roots.select(F.col("root").alias("a"), F.col("key").alias("b"))
    rows = stage(reps.join(roots, "key", "left").select("key", "vec", F.coalesce("root", "key").alias("label")).withColumn("label_no", F.xxhash64("label")), "cut-rows")
    tree = grow(rows, width, rows.count(), LEAF_ROWS)
    members = stage(placed(rows, tree, width).withColumn("own", F.col("leaf")), "cut-members")
    blocks = blocks_of(members, tree.leaves)

    def work(held: dict, asked: dict, pairs: list) -> pd.DataFrame:
        found: set[tuple[str, str]] = set()
        for _, own, who in pairs:
            y = held["x"][own]
            for s in range(0, len(who), 512):
                w = who[s : s + 512]
                other = asked["label_no"][w][:, None] != held["label_no"][own][None]
                if not other.any():
                    continue
                x = asked["x"][w]
                d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2.0 * (x @ y.T)
                q, m = np.nonzero(other & (d <= epsilon * epsilon + 1e-9))
                yes = np.sqrt(((x[q] - y[m]) ** 2).sum(1)) <= epsilon
                one, two = asked["label"][w[q[yes]]], held["label"][own[m[yes]]]
                found.update(zip(np.minimum(one, two), np.maximum(one, two)))
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    slim = members.drop("reach")
    met = block_join(slim, slim, tree, blocks, width, within_once(epsilon, tree.balls(blocks.radius)), work, "a string, b string")
    return known.unionByName(met.distinct()).where("a <> b").withColumn("w", F.lit(0.0))


def _lightest(held: dict, asked: dict, pairs: list) -> pd.DataFrame:
    """The lightest edges of each tree's asked rows to rows of other trees, all of equal weight."""
    _, group = np.unique(asked["tree_no"], return_inverse=True)
    best = np.full(int(group.max(initial=-1)) + 1, np.inf)  # of each tree
    np.minimum.at(best, group, asked["bound"] + 1e-7)  # an edge as light as the bound counts
    found = []
    for _, own, who in pairs:
        own = own[held["core"][own] <= best[group[who]].max(initial=0.0) + 1e-7]
        if not len(own):
            continue
        one, two, doubt = _sides(asked["x"][who], held["x"][own])
        for part in _steps(np.arange(len(who)), own):
            rough, w = one[part] @ two.T, who[part]
            limit = (best[group[w]] + 1e-7) ** 2 + doubt
            near = np.flatnonzero(rough.min(1) <= limit)
            if not len(near):
                continue
            q, m = np.nonzero(rough[near] <= limit[near][:, None])
            q, m = w[near[q]], own[m]
            other = asked["tree_no"][q] != held["tree_no"][m]
            q, m = q[other], m[other]
            exact = np.maximum(np.sqrt(((asked["x"][q] - held["x"][m]) ** 2).sum(1)), np.maximum(asked["core"][q], held["core"][m]))
            np.minimum.at(best, group[q], exact)
            good = exact <= best[group[q]]
            found.append((q[good], m[good], exact[good]))
    q, m, w = (np.concatenate(c) if found else np.zeros(0, dtype=np.int64) for c in (list(zip(*found)) or ((), (), ())))
    good = w <= best[group[q]]
    q, m, w = q[good], m[good], w[good].astype(np.float64)
    return pd.DataFrame({"la": asked["tree"][q], "lb": held["tree"][m], "x": asked["key"][q], "y": held["key"][m], "w": w})


def spanning_tree(vectors: DataFrame, near: DataFrame, width: int, k: int, core_k: int) -> DataFrame:
    """``a, b, w``: a minimum spanning tree of the whole mutual reachability graph of ``vectors`` (``key, v``).

    ``near`` is the result of :func:`neighbours` for ``k``. Rounds as in ``spanning_forest``: each tree but the largest takes
    its lightest edge to another. Edges of ``near`` give a bound; rows whose other edges could be as light look through all
    leaves that the bounds cannot exclude. Copies of a vector hang on the smallest key's, at their core distance.
    """
    core = core_distances(near, core_k)
    last = near.groupBy("key").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("last"))
    rows = vectors.where("key is not null and v is not null").select("key", packed("v").alias("vec")).join(core, "key").join(last, "key")
    reps, copies = _one_of_copies(rows)
    tied = copies.where("rep <> key").join(core, "key").select(F.col("rep").alias("a"), F.col("key").alias("b"), F.col("core").alias("w"))
    to = [copies.select(F.col("key").alias(c), F.col("rep").alias(f"l{c}")) for c in "ab"]
    mapped = mutual_reachability(near, core).join(to[0], "a").join(to[1], "b").where("la <> lb")
    edges = stage(mapped.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("la"), F.col("b").alias("lb")), "tree-edges")
    n = reps.count()
    tree = grow(reps, width, n, LEAF_ROWS)
    members = stage(placed(reps, tree, width).drop("last").join(reps.select("key", "last"), "key"), "tree-members")
    blocks = blocks_of(members, tree.leaves)
    trees = stage(members.select("key", F.col("key").alias("tree")), "trees")
    chosen = [tied]

    balls = tree.balls(blocks.radius)

    def visited(t: Tree, x: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        return t.reached(x, part["bound"].to_numpy() + 1e-6, balls)

    while True:
        sizes = trees.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        top = sizes.orderBy(F.col("n").desc(), "tree").limit(2).collect()
        if len(top) < 2:
            return reduce(DataFrame.unionByName, chosen)
        largest = F.lit(top[0]["tree"])
        both = edges.select("la", "lb", "a", "b", "w").unionByName(edges.select(F.col("lb").alias("la"), F.col("la").alias("lb"), "a", "b", "w")).where(F.col("la") != largest)
        placed_now = members.join(trees, "key")
        # Any one row of the largest tree bounds what a tree without known edges has to look for.
        one = placed_now.where(F.col("tree") == largest).orderBy("key").select("vec", "core").first()
        point, point_core = np.frombuffer(one["vec"], dtype=np.float64), float(one["core"])

        @F.pandas_udf(T.DoubleType())
        def to_one(vec: pd.Series, own: pd.Series) -> pd.Series:
            d = np.sqrt(((matrix(vec, width) - point) ** 2).sum(1))  # noqa: B023
            return pd.Series(np.maximum(np.maximum(d, own.to_numpy()), point_core))  # noqa: B023

        least = both.groupBy("la").agg(F.min("w").alias("known"))
        lost = placed_now.where(F.col("tree") != largest).join(least, F.col("tree") == F.col("la"), "left_anti")
        lost = lost.withColumn("w", to_one("vec", "core")).groupBy(F.col("tree").alias("la")).agg(F.min("w").alias("known"))
        bounds = least.unionByName(lost).select(F.col("la").alias("tree"), F.col("known").alias("bound"))
        held = stage(placed_now.join(bounds, "tree", "left").withColumn("tree_no", F.xxhash64("tree")).drop("reach"), "tree-held")
        asked = held.where("bound is not null and last - 1e-6 <= bound")
        slim = held.drop("last").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
        met = block_join(slim, asked.drop("last"), tree, blocks, width, visited, _lightest, "la string, lb string, x string, y string, w double")
        met = met.select("la", "lb", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")
        best = stage(both.unionByName(met).groupBy("la").agg(F.min(F.struct("w", "a", "b", "lb")).alias("e")).select("la", "e.*"), "tree-best")
        chosen.append(best.select("a", "b", "w").distinct())
        back = best.select(F.col("la").alias("lb"), F.col("lb").alias("back"))
        mutual = (F.col("back") == F.col("la")) & (F.col("la") < F.col("lb"))
        hooks = best.join(back, "lb", "left").select(F.col("la").alias("key"), F.when(mutual, F.col("la")).otherwise(F.col("lb")).alias("to"))
        labels = follow(hooks.unionByName(trees.limit(1).select(largest.alias("key"), largest.alias("to"))))
        trees = stage(trees.join(labels.withColumnRenamed("key", "tree"), "tree").select("key", F.col("label").alias("tree")), "trees")
        left = edges.join(labels.select(F.col("key").alias("la"), F.col("label").alias("na")), "la").join(labels.select(F.col("key").alias("lb"), F.col("label").alias("nb")), "lb")
        edges = stage(left.where("na <> nb").select("a", "b", "w", F.col("na").alias("la"), F.col("nb").alias("lb")), "tree-edges")
        unstage(held)


def two_means(vectors: DataFrame, width: int, rounds: int = 10) -> DataFrame:
    """``key, v, label`` (0 or 1) of ``key, v``: two-means from the smallest key's row and the row farthest from it.

    Each round is one sum over the table; only two centres are on the driver. A row as near to both belongs to 0.
    """
    rows = stage(vectors.where("v is not null").select("key", "v"), "two-means-rows")
    seed = rows.agg(F.min_by("v", "key").alias("v")).first()
    if seed is None or seed["v"] is None:
        return rows.select("key", "v", F.lit(0).alias("label"))
    far = rows.agg(F.max_by("v", F.struct(euclidean(F.col("v"), F.lit(list(seed["v"]))), "key")).alias("v")).first()["v"]
    centres = np.array([seed["v"], far], dtype=np.float64)
    for _ in range(rounds):
        now = centres

        def part(b: pd.DataFrame) -> np.ndarray:
            x = np.array(b["v"].tolist(), dtype=np.float64)
            d = ((x[:, None, :] - now[None]) ** 2).sum(2)
            at = (d[:, 1] < d[:, 0]).astype(int)
            out = np.zeros((2, width + 1))
            for j in (0, 1):
                out[j, 0], out[j, 1:] = (at == j).sum(), x[at == j].sum(0)
            return out

        sums = matrix_sum(rows.select("v"), (2, width + 1), part)
        centres = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)
        if np.allclose(centres, now, rtol=0, atol=1e-12):
            break
    a, b = (F.lit(c.tolist()) for c in centres)
    return rows.select("key", "v", (euclidean(F.col("v"), b) < euclidean(F.col("v"), a)).cast("int").alias("label"))


def small_group(labelled: DataFrame, scores: DataFrame, small: float = 0.05, high: float = 0.95) -> dict:
    """What one round of the filter sees and decides: sizes, the smaller label, its scored and sure members, ``remove``.

    The smaller of two equal groups is 1. It is removed if its share is at most ``small`` and it has scored members but
    none of a score of at least ``high``.
    """
    joined = labelled.join(scores, "key", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.count_if(F.col("score") >= high).alias("sure"))
    by = {r["label"]: r for r in joined.collect()}
    sizes = [by[j]["n"] if j in by else 0 for j in (0, 1)]
    label = 0 if sizes[0] < sizes[1] else 1
    share = sizes[label] / max(sum(sizes), 1)
    scored, sure = (by[label]["scored"], by[label]["sure"]) if label in by else (0, 0)
    return {"rows": sum(sizes), "small_label": label, "small_rows": sizes[label], "share": share, "scored": scored, "sure": sure, "remove": bool(sizes[label] and share <= small and scored and not sure)}


def filter_small_groups(vectors: DataFrame, width: int, scores: DataFrame, small: float = 0.05, high: float = 0.95, rounds: int = 10, least: int = 10) -> tuple[DataFrame, list[dict]]:
    """Removes small groups without a sure member, one a round, and what each round saw."""
    now, seen = vectors.select("key", "v"), []
    for _ in range(rounds):
        if now.limit(least).count() < least:
            break
        labelled = stage(two_means(now, width), "two-means")
        seen.append(small_group(labelled, scores, small, high))
        if not seen[-1]["remove"]:
            break
        now = labelled.where(F.col("label") != seen[-1]["small_label"]).select("key", "v")
    return now, seen


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]]:
    """Of rows sorted by group, lane and role: the centres of each lane, their vectors, its rows and theirs."""

    def split(held: list[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]]:
        b = pd.concat(held, ignore_index=True)
        centres, own = b[b["role"] == 0], b[b["role"] == 1]
        if len(centres) and len(own):
            yield centres, np.array(centres["v"].tolist(), dtype=np.float64), own, np.array(own["v"].tolist(), dtype=np.float64)

    held: list[pd.DataFrame] = []
    at = None
    for b in batches:
        if not len(b):
            continue
        grp, lane = b["grp"].to_numpy(dtype=object), b["lane"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (lane[1:] != lane[:-1])])
        for s, e in zip(cuts, [*cuts[1:], len(b)]):
            if held and (grp[s], lane[s]) != at:
                yield from split(held)
                held = []
            at = (grp[s], lane[s])
            held.append(b.iloc[s:e])
    if held:
        yield from split(held)


def _meet(rows: DataFrame, centres: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(centres, c, rows, x)`` for every lane of every group; a lane's rows and its group's centres are in one task.

    ``rows`` has ``grp, lane, key, v, far``, ``centres`` has ``grp, no, v, lanes`` and goes to each of its group's lanes.
    """
    kinds, n = dict(rows.dtypes), shuffle_partitions(rows.sparkSession)
    sent = centres.select("grp", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(0).alias("role"), "no", F.lit(None).cast(kinds["key"]).alias("key"), "v", F.lit(None).cast("double").alias("far"))
    own = rows.select("grp", "lane", F.lit(1).alias("role"), F.lit(0).alias("no"), "key", "v", "far")
    met = sent.unionByName(own).repartition(n, "grp", "lane").sortWithinPartitions("grp", "lane", "role", "no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(batches):
            yield work(*part)

    return met.mapInPandas(run, schema)


def _nearest(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, the first of equals."""
    label, step = np.zeros(len(x), dtype=np.int32), max(1, CELLS // len(c))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        d = (part**2).sum(1)[:, None] + (c * c).sum(1)[None] - 2.0 * (part @ c.T)
        label[s : s + step] = np.round(d, 12).argmin(1)
    return label


def _pick(far_rows: pd.DataFrame) -> pd.DataFrame:
    """The next centres of a group, of its ``FIRST_ROWS`` rows farthest from those it has: always the farthest row.

    If the group has more rows, those not here are at most as far as the nearest row here was at first, so that choosing
    goes on only while the farthest row here is farther than that.
    """
    t = far_rows.sort_values("key", ignore_index=True)
    x, far = np.array(t["v"].tolist(), dtype=np.float64), t["far"].to_numpy(dtype=np.float64).copy()
    k, have, whole = int(t["k"].iloc[0]), int(t["have"].iloc[0]), int(t["n"].iloc[0]) <= len(t)
    floor, chosen = -1.0 if whole else far.min(), []
    while have + len(chosen) < k:
        i = int(far.argmax())
        if far[i] <= 0 or (chosen and far[i] <= floor):
            break
        chosen.append(i)
        far = np.minimum(far, np.round(((x - x[i]) ** 2).sum(1), 12))
    grp, v = pd.Series([t["grp"].iloc[0]] * len(chosen), dtype=object), pd.Series([x[i] for i in chosen], dtype=object)
    return pd.DataFrame({"grp": grp, "no": np.arange(have, have + len(chosen), dtype=np.int32), "v": v, "done": whole or have + len(chosen) >= k})


def _first_centres(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, no, v, lanes``: of all rows of a group the smallest key's, then always the one farthest from those so far.

    Exact for any k and any number of rows. A round updates all distances and chooses as many centres as its farthest rows
    decide (see :func:`_pick`); groups of up to ``FIRST_ROWS`` rows take one. A group of fewer distinct vectors than k gets
    one centre for each.
    """
    kind = dict(rows.dtypes)["grp"]

    def update(centres: pd.DataFrame, c: np.ndarray, own: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        far = own["far"].to_numpy(dtype=np.float64).copy()
        for one in c:
            far = np.minimum(far, np.round(((x - one) ** 2).sum(1), 12))
        return own[["grp", "lane", "key", "v"]].assign(far=far)

    now, going = rows, groups.withColumn("have", F.lit(1))
    found = stage(rows.groupBy("grp").agg(F.min_by("v", "key").alias("v")).select("grp", F.lit(0).alias("no"), "v").join(groups.select("grp", "lanes"), "grp"), "split-first")
    chosen = [found]
    schema = ", ".join(f"{c} {t}" for c, t in rows.select("grp", "lane", "key", "v", "far").dtypes)
    farthest = Window.partitionBy("grp").orderBy(F.col("far").desc(), "key")  # cut to FIRST_ROWS before the shuffle as well
    while going.limit(1).count():
        then = stage(_meet(now.join(going.select("grp"), "grp", "left_semi"), found, update, schema), "split-far")
        if now is not rows:
            unstage(now)
        now = then
        top = now.withColumn("place", F.row_number().over(farthest)).where(F.col("place") <= FIRST_ROWS).select("grp", "key", "v", "far")
        picked = stage(top.join(going, "grp").groupBy("grp").applyInPandas(_pick, f"grp {kind}, no int, v array<double>, done boolean"), "split-picked")
        found = picked.select("grp", "no", "v").join(groups.select("grp", "lanes"), "grp")
        chosen.append(found)
        left = picked.groupBy("grp").agg((F.max("no") + 1).alias("have"), F.max("done").alias("done")).where("not done").drop("done")
        going = stage(groups.join(left, "grp"), "split-going")
    return reduce(DataFrame.unionByName, chosen)


def split_groups(rows: DataFrame, k: DataFrame, rounds: int = 5) -> DataFrame:
    """``grp, key, label``: k-means of every group at once, on vectors of length 1.

    ``rows`` has ``grp, key, v``, ``k`` has ``grp, k``. First centres are chosen farthest first among all rows of a group; the
    means of the ``rounds`` are over all rows, summed per lane first. A group's rows are spread over lanes of about
    ``LANE_ROWS``; each lane's task holds the group's centres, one row each.
    """
    kinds = dict(rows.dtypes)
    kind = kinds["grp"]
    unit_rows = rows.join(k.select("grp", "k"), "grp").select("grp", "key", "k", unit(F.col("v")).alias("v")).where("v is not null")
    unit_rows = stage(unit_rows, "split-rows")
    groups = stage(unit_rows.groupBy("grp").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n")).withColumn("lanes", F.ceil(F.col("n") / LANE_ROWS).cast("int")), "split-groups")
    laned = unit_rows.join(groups.select("grp", "lanes"), "grp").select("grp", F.pmod(F.xxhash64("key"), F.col("lanes")).cast("int").alias("lane"), "key", "v", F.lit(float("inf")).alias("far"))
    centres = _first_centres(laned, groups)

    def sums(centres: pd.DataFrame, c: np.ndarray, own: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        label = _nearest(c, x)
        order = np.argsort(label, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
        total = np.add.reduceat(x[order], edge, axis=0)
        return pd.DataFrame({"grp": own["grp"].iloc[0], "label": label[order[edge]], "n": np.diff(np.r_[edge, len(order)]), "total": list(total)})

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        found = part.groupby("label").agg({"n": "sum", "total": "sum"}).sort_index()
        return pd.DataFrame({"grp": part["grp"].iloc[0], "no": found.index.to_numpy(dtype=np.int32), "v": [(t / n).tolist() for n, t in zip(found["n"], found["total"])]})

    for _ in range(rounds):
        partial = _meet(laned, centres, sums, f"grp {kind}, label int, n long, total array<double>")
        # A task has a sum per lane of 64 centres of one group.
        means = partial.withColumn("piece", F.floor(F.col("label") / 64)).groupBy("grp", "piece").applyInPandas(mean, f"grp {kind}, no int, v array<double>")
        centres = stage(means.join(groups.select("grp", "lanes"), "grp"), "split-centres")

    def labels(centres: pd.DataFrame, c: np.ndarray, own: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        return own[["grp", "key"]].assign(label=_nearest(c, x))

    return _meet(laned, centres, labels, f"grp {kind}, key {kinds['key']}, label int")
