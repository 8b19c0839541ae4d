"""A hierarchical k-means tree over vectors, and blocks of its leaves for joins.

The tree is fitted on bounded samples: its upper part on one sample of the table, and, where the table wants more leaves than
that sample carries, a subtree for each of its leaves on a sample of that leaf's rows. Every row is then placed by descent to
the nearest child. Consecutive leaves are put into blocks of a bounded number of rows, and a leaf with more rows than that
is spread over several blocks, so that neither a dense region nor a group of copies makes a large task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandbin.runtime import shuffle_partitions

#: Rows that the upper part of the tree, and each subtree, is fitted on, at most.
SAMPLE_ROWS, SUBTREE_ROWS = 32_768, 4_096
#: Sampled rows a leaf should have at least.
SAMPLE_PER_LEAF = 32
#: Leaves a tree has at most, as it is broadcast; beyond, leaves grow with the table.
MOST_LEAVES = 65_536
#: Rows a block holds at most; tables of more rows than BLOCKS such blocks hold have larger ones, up to the second number,
#: as a row that visits most leaves is sent to most blocks.
BLOCK_ROWS, LARGE_BLOCK_ROWS, BLOCKS = 32_768, 98_304, 32
BRANCHES = 8
#: Queries that a block's members meet at once: as a table grows, fewer of them visit the same leaf.
ASKED_ROWS = 8_192
#: Tasks of a join for each core, if it has that many shuffle partitions.
TASKS_A_CORE = 8
#: Rows of a query batch times leaves of the tree that are looked at at once, about.
ROUTE_CELLS = 1 << 24


@dataclass
class Tree:
    """Node 0 is the root. ``children[i]`` is empty for a leaf; ``leaf_no[i]`` numbers the leaves in depth-first order."""

    centre: np.ndarray
    children: list[list[int]]
    leaf_no: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf_no.max()) + 1

    @property
    def leaf_centre(self) -> np.ndarray:
        out = np.empty((self.leaves, self.centre.shape[1]))
        out[self.leaf_no[self.leaf_no >= 0]] = self.centre[self.leaf_no >= 0]
        return out

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), dtype=np.int64)
        open_nodes = [(0, np.arange(len(x)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            kids = self.children[node]
            if not kids:
                at[rows] = self.leaf_no[node]
                continue
            pick = squared(x[rows], self.centre[kids]).argmin(1)
            open_nodes += [(kid, part) for i, kid in enumerate(kids) if len(part := rows[pick == i])]
        return at

    def nearest_leaves(self, x: np.ndarray, n: int) -> np.ndarray:
        """Which leaves (columns) each row visits: the n of the nearest centres among those under the row's own upper node.

        Enough for a first bound; rows near an upper node's edge get leaves on their own side only.
        """
        own, found = self.place(x), np.zeros((len(x), self.leaves), dtype=bool)
        parent = np.full(len(self.children), -1)
        for i, kids in enumerate(self.children):
            parent[kids] = i
        node_of = np.empty(self.leaves, dtype=np.int64)
        node_of[self.leaf_no[self.leaf_no >= 0]] = np.flatnonzero(self.leaf_no >= 0)
        order = np.argsort(own, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0]) if len(x) else []
        for a, e in zip(edge, [*edge[1:], len(order)]):
            node, under = int(node_of[own[order[a]]]), []
            while len(under) < n and parent[node] >= 0:
                node = int(parent[node])
                under = self._under(node)
            under = np.array(under or [node])
            rows = order[a:e]
            near = np.argsort(squared(x[rows], self.centre[under]), axis=1, kind="stable")[:, :n]
            found[rows[:, None], self.leaf_no[under[near]]] = True
        return found

    def _under(self, node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            i = stack.pop()
            stack += self.children[i]
            if not self.children[i]:
                out.append(i)
        return out

    def balls(self, radius: np.ndarray) -> np.ndarray:
        """For each node a distance from its centre that no row under it exceeds, from those of the leaves."""
        out = np.zeros(len(self.children))
        for node in range(len(self.children) - 1, -1, -1):  # children come after their node
            kids = self.children[node]
            if kids:
                out[node] = (np.sqrt(squared(self.centre[kids], self.centre[[node]])[:, 0]) + out[kids]).max()
            else:
                out[node] = radius[self.leaf_no[node]]
        return out

    def reachable(self, x: np.ndarray, reach: np.ndarray, balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row and leaf, by row: see :func:`reached`."""
        return np.nonzero(self.reached(x, reach, balls))

    def reached(self, x: np.ndarray, reach: np.ndarray, balls: np.ndarray) -> np.ndarray:
        """Which leaves (columns) may hold rows within ``reach`` of each row; a byte for each, as they may be nearly all.

        On the way down two bounds leave nodes out: the ball of the node (see :func:`balls`), and the planes between a node
        and its siblings, as all rows of a node are nearer to its centre. Only nodes that are not left out are looked at.
        """
        found, stack = np.zeros((len(x), self.leaves), dtype=bool), [(0, np.arange(len(x)), np.zeros(len(x)))]
        while stack:
            node, rows, bound = stack.pop()
            kids = self.children[node]
            if not kids:
                found[rows, self.leaf_no[node]] = True
                continue
            c = self.centre[kids]
            d2 = squared(x[rows], c)
            between = np.sqrt(squared(c, c))
            between[between <= 1e-9] = np.inf
            planes = ((d2[:, :, None] - d2[:, None, :]) / (2 * between)[None]).max(2)
            low = np.maximum(np.maximum(np.sqrt(d2) - balls[kids], planes), bound[:, None])
            keep = low <= reach[rows][:, None]
            stack += [(kid, rows[k], low[k, j]) for j, kid in enumerate(kids) if (k := np.flatnonzero(keep[:, j])).size]
        return found


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T), 0.0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = squared(x, centre).argmin(1)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        used = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(n[used])[:-1]], axis=0)
        centre = centre.copy()
        centre[used] = sums / n[used][:, None]
    return centre, squared(x, centre).argmin(1)


def fit_tree(sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """Splits the node with the most sampled rows into ``branches`` children, until there are ``leaves`` leaves."""
    rng = np.random.default_rng(seed)
    centre, children = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [[]]
    members: dict[int, np.ndarray] = {0: np.arange(len(sample))}
    while len(members) < leaves:
        node = max(members, key=lambda i: (len(members[i]), -i))
        rows = members[node]
        if len(rows) < 2 * branches:
            break
        k = min(branches, leaves - len(members) + 1)
        c, at = _kmeans(sample[rows], k, rng)
        parts = [(c[i], rows[at == i]) for i in range(k) if (at == i).any()]
        if len(parts) < 2:  # copies only
            members[node] = rows[:1]
            if all(len(m) < 2 * branches for m in members.values()):
                break
            continue
        del members[node]
        for mean, part in parts:
            children[node].append(len(centre))
            members[len(centre)] = part
            centre.append(mean)
            children.append([])
    return Tree(np.asarray(centre, dtype=np.float64), children, _leaf_numbers(children))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """The doubles of a column of packed vectors."""
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), width)


def _sampled(members: DataFrame, share: float) -> DataFrame:
    """About that share of the rows, by a digest of their vector."""
    return members.where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < int(min(share, 1.0) * 1_000_000) + 1)


def grow(members: DataFrame, width: int, rows: int, leaf_rows: int) -> Tree:
    """A tree for ``members`` (column ``vec``: packed doubles) of known row count, with about a leaf for ``leaf_rows`` rows."""
    wanted = max(1, min(rows // leaf_rows, MOST_LEAVES))
    picked = _sampled(members, 1.2 * SAMPLE_ROWS / max(rows, 1)).select("vec").limit(SAMPLE_ROWS).toPandas()
    sample = matrix(picked["vec"], width) if len(picked) else np.zeros((0, width))
    top = fit_tree(sample, max(1, min(wanted, len(sample) // SAMPLE_PER_LEAF)))
    return _with_subtrees(top, members, width, rows, wanted) if wanted > top.leaves > 1 and len(sample) == SAMPLE_ROWS else top


def _with_subtrees(top: Tree, members: DataFrame, width: int, rows: int, wanted: int) -> Tree:
    """``top`` with its leaves replaced by trees of their own, fitted side by side, one group a leaf."""
    share = min(1.0, 1.2 * SUBTREE_ROWS * top.leaves / rows)
    some = placed(_sampled(members, share).select("vec"), top, width).drop("reach")
    sizes = some.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))  # at most one row a leaf of the upper part
    total = max(sizes.agg(F.sum("n")).first()[0] or 1, 1)
    first = Window.partitionBy("leaf").orderBy(F.xxhash64("vec"))  # cut to SUBTREE_ROWS before the shuffle as well
    kept = some.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SUBTREE_ROWS).join(F.broadcast(sizes), "leaf").select("leaf", "vec", "n")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        sample = matrix(part["vec"], width)
        leaves = min(round(part["n"].iloc[0] / total * wanted), len(sample) // SAMPLE_PER_LEAF)
        t = fit_tree(sample, leaves) if leaves > 1 else None
        if t is None or t.leaves < 2:
            return pd.DataFrame({"leaf": [], "centre": [], "parent": []})
        parent = np.zeros(len(t.children), dtype=np.int32)
        for i, kids in enumerate(t.children):
            parent[kids] = i
        return pd.DataFrame({"leaf": [part["leaf"].iloc[0]], "centre": [t.centre.tobytes()], "parent": [parent.tobytes()]})

    fitted = kept.groupBy("leaf").applyInPandas(fit, "leaf int, centre binary, parent binary").orderBy("leaf").collect()
    centre, children = [top.centre], [list(k) for k in top.children]
    node_of = {int(no): i for i, no in enumerate(top.leaf_no) if no >= 0}
    for r in fitted:
        own = np.frombuffer(r["centre"], dtype=np.float64).reshape(-1, width)
        at, node = len(children) - 1, node_of[r["leaf"]]  # node i > 0 of the subtree becomes node i + at
        children += [[] for _ in own[1:]]
        for i, parent in enumerate(np.frombuffer(r["parent"], dtype=np.int32)[1:].tolist(), 1):
            children[parent + at if parent else node].append(i + at)
        centre.append(own[1:])
    return Tree(np.concatenate(centre), children, _leaf_numbers(children))


def _leaf_numbers(children: list[list[int]]) -> np.ndarray:
    """Numbers of the leaves in depth-first order, -1 for other nodes."""
    leaf_no, n, stack = np.full(len(children), -1), 0, [0]
    while stack:
        node = stack.pop()
        if children[node]:
            stack += children[node][::-1]
        else:
            leaf_no[node], n = n, n + 1
    return leaf_no


def placed(members: DataFrame, tree: Tree, width: int) -> DataFrame:
    """``members`` with ``leaf`` and ``reach``, the distance to the leaf's centre."""
    shared = members.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        centre = t.leaf_centre
        for b in batches:
            if len(b):
                x = matrix(b["vec"], width)
                leaf = t.place(x)
                yield b.assign(leaf=leaf.astype(np.int32), reach=np.sqrt(((x - centre[leaf]) ** 2).sum(1)))

    schema = ", ".join(f"`{c}` {k}" for c, k in members.dtypes)
    return members.mapInPandas(run, schema + ", leaf int, reach double")


@dataclass
class Blocks:
    """Leaf -> blocks. ``first[leaf]`` and ``count[leaf]`` give the blocks over which the leaf's rows are spread."""

    first: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    total: int

    @property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """For each block its first leaf and the one after its last."""
        low, high = np.full(self.total, len(self.first)), np.zeros(self.total, dtype=np.int64)
        for leaf, (a, n) in enumerate(zip(self.first, self.count)):
            low[a : a + n], high[a : a + n] = np.minimum(low[a : a + n], leaf), leaf + 1
        return low, high


def blocks_of(members: DataFrame, leaves: int, block_rows: int | None = None) -> Blocks:
    """Packs leaves, in tree order, into blocks of up to ``block_rows`` rows. One row per leaf comes to the driver."""
    found = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).toPandas()
    n, radius = np.zeros(leaves, dtype=np.int64), np.zeros(leaves)
    n[found["leaf"]], radius[found["leaf"]] = found["n"], found["r"]
    block_rows = block_rows or int(np.clip(n.sum() // BLOCKS, BLOCK_ROWS, LARGE_BLOCK_ROWS))
    first, count = np.zeros(leaves, dtype=np.int32), np.ones(leaves, dtype=np.int32)
    block, filled = 0, 0
    for leaf in range(leaves):
        if n[leaf] > block_rows:
            block += bool(filled)
            first[leaf], count[leaf] = block, -(-n[leaf] // block_rows)
            block, filled = block + int(count[leaf]), 0
            continue
        if filled + n[leaf] > block_rows:
            block, filled = block + 1, 0
        first[leaf] = block
        filled += n[leaf]
    return Blocks(first, count, radius, block + 1)


def block_join(
    members: DataFrame,
    queries: DataFrame,
    tree: Tree,
    blocks: Blocks,
    width: int,
    visited: Callable[[Tree, np.ndarray, pd.DataFrame], np.ndarray],
    work: Callable[[dict, dict, list[tuple[int, np.ndarray, np.ndarray]]], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Meets every query with the members of the leaves it visits.

    ``members`` has ``key, vec, leaf`` and what ``work`` reads besides; ``queries`` has ``key, vec`` and the same. ``visited(tree, x,
    rows)`` gives for the vectors x of ``rows`` a matrix of truth values, rows by leaves. A row goes to a block with a bit for
    each of the block's leaves. Rows are brought together by block and sorted, members first, so a task holds the members of
    one block and streams the queries. If there are fewer blocks than tasks wanted (so many a core, and no more than shuffle
    partitions), the queries of a block are dealt to several tasks, each with a copy of its members. ``work(members, queries,
    pairs)`` gets both as dicts of arrays and for each leaf the places of its members and of the queries that visit it.
    """
    spark = members.sparkSession
    shared = spark.sparkContext.broadcast((tree, blocks))
    extra = [c for c in members.columns if c not in ("key", "vec", "leaf", "reach")]
    kinds = dict(members.dtypes)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, where = shared.value
        step = max(64, min(8192, ROUTE_CELLS // t.leaves))
        for b in batches:
            for start in range(0, len(b), step):
                part = b.iloc[start : start + step]
                wide = visited(t, matrix(part["vec"], width), part)
                for block, (low, high) in enumerate(zip(*where.spans)):
                    at = np.flatnonzero(wide[:, low:high].any(1))
                    if len(at):
                        bits = np.packbits(wide[at, low:high], axis=1)
                        out = part.iloc[at].copy()
                        out["block"], out["leaves"] = np.int32(block), [row.tobytes() for row in bits]
                        yield out

    columns = ", ".join(f"`{c}` {kinds[c]}" for c in ["key", "vec", *extra])
    wanted = min(shuffle_partitions(spark), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    lanes = min(16, max(1, -(-wanted // blocks.total)))
    n = min(blocks.total * lanes, 8 * shuffle_partitions(spark))
    own_lane = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(lanes)).cast("int")
    routed = queries.select("key", "vec", *extra).mapInPandas(route, columns + ", block int, leaves binary").withColumn("block", F.col("block") * lanes + own_lane).withColumn("role", F.lit(1)).withColumn("leaf", F.lit(-1))
    first, count = F.lit(blocks.first.tolist()), F.lit(blocks.count.tolist())
    spread = F.pmod(F.xxhash64("key"), F.get(count, F.col("leaf"))).cast("int")
    at = (F.get(first, F.col("leaf")) + spread).cast("int") * lanes
    stored = members.select("key", "vec", *extra, at.alias("block"), F.lit(None).cast("binary").alias("leaves"), F.lit(0).alias("role"), "leaf")
    stored = stored.withColumn("block", F.explode(F.sequence(F.col("block"), F.col("block") + lanes - 1)))
    met = stored.unionByName(routed).repartitionById(n, F.pmod("block", F.lit(n)).cast("int")).sortWithinPartitions("block", "role", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, held, by_leaf = None, [], None, {}
        spans = shared.value[1].spans
        for b in batches:
            cuts = np.flatnonzero(np.r_[True, (b["block"].to_numpy()[1:] != b["block"].to_numpy()[:-1]) | (b["role"].to_numpy()[1:] != b["role"].to_numpy()[:-1])]) if len(b) else []
            for a, e in zip(cuts, [*cuts[1:], len(b)]):
                part = b.iloc[a:e]
                if part["block"].iloc[0] != block:
                    block, parts, held = int(part["block"].iloc[0]), [], None
                if part["role"].iloc[0] == 0:
                    parts.append((matrix(part["vec"], width), part.drop(columns=["vec", "leaves"])))
                    continue
                if held is None:
                    if not parts:
                        continue
                    rest = pd.concat([p for _, p in parts], ignore_index=True)
                    held = {c: rest[c].to_numpy() for c in ["key", "leaf", *extra]} | {"x": np.concatenate([x for x, _ in parts])}
                    held["x32"], parts = held["x"].astype(np.float32), []
                    order = np.argsort(held["leaf"], kind="stable")
                    edge = np.flatnonzero(np.r_[True, np.diff(held["leaf"][order]) != 0])
                    by_leaf = {int(held["leaf"][order[a0]]): order[a0:e0] for a0, e0 in zip(edge, [*edge[1:], len(order)])}
                for s in range(0, len(part), ASKED_ROWS):
                    sub = part.iloc[s : s + ASKED_ROWS]
                    asked = {c: sub[c].to_numpy() for c in ["key", *extra]} | {"x": matrix(sub["vec"], width)}
                    asked["x32"] = asked["x"].astype(np.float32)
                    low, high = (int(ends[block // lanes]) for ends in spans)
                    bits = np.frombuffer(b"".join(sub["leaves"]), dtype=np.uint8).reshape(len(sub), -1)
                    wide = np.unpackbits(bits, axis=1, count=high - low).astype(bool)
                    pairs = [(leaf, by_leaf[leaf], who) for leaf in range(low, high) if leaf in by_leaf and len(who := np.flatnonzero(wide[:, leaf - low]))]
                    out = work(held, asked, pairs)
                    if len(out):
                        yield out

    return met.mapInPandas(run, schema)


def within_once(reach: float, balls: np.ndarray) -> Callable:
    """Leaves that may hold rows within ``reach``, for :func:`block_join`; every pair of rows meets once.

    Of two leaves only the rows of one visit the other. Which one depends on both numbers' parity, so each leaf is visited
    from about half of the others. The rows' own leaf is in their column ``own``.
    """

    def once(tree: Tree, x: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        wide = tree.reached(x, np.full(len(x), reach + 1e-6), balls)
        own, leaf = part["own"].to_numpy()[:, None], np.arange(tree.leaves, dtype=np.int32)[None]
        wide &= (own == leaf) | ((own < leaf) == (own % 2 == leaf % 2))
        return wide

    return once
