import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandbin.functions import dna, rules
from strandbin.operators import chimera, cluster, embed
from strandbin.operators import skew
from strandbin.operators.coverage import clamp_fragments, coverage_of_contigs, depth_intervals, fragment_coverage, running_depth
from strandbin.operators.fragments import augment_fragments, positive_pairs, shuffled
from strandbin.operators.graph import merge_labels, spanning_forest
from strandbin.operators.kmers import kmer_counts, kmer_multi, kmer_profiles
from strandbin.operators.skew import join_by_key
from strandbin.operators.quality import best_lines, duplicated_genes, merge_refined, scored_lines
from strandbin.runtime import stage


def _rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_index_is_shared_by_reverse_complements():
    index = dna.canonical_index(4, dna.PROFILE_ALPHABET)
    assert index.max() == 135
    words = ["".join(w) for w in itertools.product("ACGT", repeat=4)]
    by = dict(zip(words, index))
    assert all(by[w] == by[_rc(w)] for w in words)
    assert (by["AAAA"], by["AAAT"], by["AAAG"], by["CCCC"]) == (0, 1, 2, 117)


def test_kmer_counts(spark):
    r = random.Random(0)
    seqs = ["".join(r.choices("ACGTacgtN-", k=n)) for n in (0, 3, 4, 5, 90, 700)]
    rows = [(i, s) for i, s in enumerate(seqs)] + [(99, None)]
    got = {x["id"]: x["counts"] for x in kmer_counts(spark.createDataFrame(rows, "id int, seq string"), "id", "seq").collect()}
    index = dna.canonical_index(4, dna.PROFILE_ALPHABET)
    for i, s in enumerate(seqs):
        want = [0] * 136
        for p in range(len(s) - 3):
            w = s[p : p + 4].upper()
            if set(w) <= set("ACGT"):
                want[index[sum("ACGT".index(c) * 4 ** (3 - j) for j, c in enumerate(w))]] += 1
        assert got[i] == want
    assert got[99] is None


def test_profile_sums_to_one_and_ignores_strand(spark):
    s = "ACGTTGCAAGTCCAGNTTACG" * 4
    df = spark.createDataFrame([("a", s), ("b", _rc(s)), ("c", "")], "id string, seq string")
    got = {r["id"]: r["profile"] for r in kmer_profiles(df, "id", "seq").collect()}
    assert all(abs(sum(p) - 1) < 1e-9 for p in got.values())
    assert got["a"] == pytest.approx(got["b"])
    assert got["c"] == pytest.approx([1 / 136] * 136)


def test_multi_scale_wants_clean_sequences(spark):
    df = spark.createDataFrame([("a", "ACGTACGTAA"), ("n", "ACGTNACGTAA"), ("s", "AC")], "id string, seq string")
    got = {(r["id"], r["k"]): (r["places"], r["freqs"]) for r in kmer_multi(df, "id", "seq").collect()}
    assert all(sum(got["a", k][1]) == pytest.approx(1) for k in range(3, 8))
    assert not got["n", 3][0] and not got["s", 3][0]


def test_coverage_equals_bases(spark):
    r = random.Random(3)
    reads = [(r.choice("xy"), r.choice("cd"), s := r.randrange(80), min(s + r.randrange(40), 100)) for _ in range(300)]
    frags = [(f"f{i}", r.choice("cde"), r.choice([-5, 0, 10, 60, 99, 120, None]), r.choice([0, 5, 30, 500, None])) for i in range(60)]
    lengths = spark.createDataFrame([("c", 100), ("d", 100), ("e", 100)], "contig string, length int")
    alignments = spark.createDataFrame(reads, "sample string, contig string, start int, end int")
    clamped = clamp_fragments(spark.createDataFrame(frags, "fragment string, contig string, start_pos int, length int"), lengths)
    got = {(x["sample"], x["fragment"]): (x["mean"], x["std"]) for x in fragment_coverage(alignments, clamped, ("x", "y")).collect()}
    depth = np.zeros((2, 3, 100))
    for s, c, a, e in reads:
        depth["xy".index(s), "cde".index(c), a:e] += 1
    for f, c, a, n in frags:
        good = a is not None and n is not None and 0 <= a < 100 and n > 0
        for s in "xy":
            d = depth["xy".index(s), "cde".index(c), a : min(a + n, 100)] if good else np.zeros(1)
            assert got[s, f] == pytest.approx((d.mean(), d.std()), abs=1e-9)
    runs = depth_intervals(alignments).collect()
    again = np.zeros_like(depth)
    for x in runs:
        again["xy".index(x["sample"]), "cde".index(x["contig"]), x["start"] : x["end"]] += x["depth"]
    assert (again == depth).all()


def test_augmentation_follows_the_rules(spark):
    df = spark.createDataFrame([("a", 5000), ("b", 900), ("long", 60_001), ("null", None), ("c", 1000)], "contig string, length int")
    rows = augment_fragments(df, 1000).collect()
    by = {}
    for r in rows:
        by.setdefault((r["contig"], r["half"]), []).append(r)
    assert {r["contig"] for r in rows} == {"a", "long", "c"}
    assert set(by) == {("a", None), ("long", None), ("long", "h1"), ("long", "h2"), ("c", None)}
    for (contig, half), group in by.items():
        aug = [r for r in group if r["kind"] == "aug"]
        lo, hi = {"h1": (0, 30_000), "h2": (30_000, 60_001)}.get(half, (0, {"a": 5000, "c": 1000, "long": 60_001}[contig]))
        assert len(aug) <= 8 and sorted(r["ordinal"] for r in aug) == list(range(len(aug)))
        assert all(r["length"] >= 1000 and lo <= r["start_pos"] and r["start_pos"] + r["length"] <= hi for r in aug)
        for x, y in itertools.combinations(aug, 2):
            common = max(0, min(x["start_pos"] + x["length"], y["start_pos"] + y["length"]) - max(x["start_pos"], y["start_pos"]))
            assert common < 0.25 * max(x["length"], y["length"])
    assert rows == augment_fragments(df, 1000).collect()


def test_pairs(spark):
    rows = [("g", f"m{i:02}") for i in range(12)] + [("h", "x"), ("h", "y"), ("i", "z"), (None, "q"), ("h", "x")]
    df = spark.createDataFrame(rows, "g string, m string")
    every = {tuple(r) for r in positive_pairs(df, "g", "m", 1000).collect()}
    assert every == {("g", *p) for p in itertools.combinations([f"m{i:02}" for i in range(12)], 2)} | {("h", "x", "y")}
    some = [tuple(r) for r in positive_pairs(df, "g", "m", 20).collect()]
    assert len(some) == len(set(some)) == 20 and set(some) <= every
    assert positive_pairs(df.limit(0), "g", "m", 5).count() == 0


def test_labels_and_forest(spark):
    r = random.Random(5)
    edges = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}", round(r.random(), 2)) for _ in range(70)] + [(f"c{i:02}", f"c{i + 1:02}", 1.0) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    weight = 0.0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            weight += w
    df = spark.createDataFrame(edges, "a string, b string, w double")
    forest = spanning_forest(df).collect()
    nodes = {x for a, b, _ in edges if a != b for x in (a, b)}
    assert sum(e["w"] for e in forest) == pytest.approx(weight)
    assert len(forest) == len(nodes) - len({find(n) for n in nodes})
    labels = {x["label"]: x["root"] for x in merge_labels(df.where("a <> b").select("a", "b")).collect()}
    smallest = {}
    for n in nodes:
        smallest[find(n)] = min(smallest.get(find(n), n), n)
    assert labels == {n: smallest[find(n)] for n in nodes}
    assert spanning_forest(df.limit(0)).count() == 0


def test_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LEAF_ROWS", 20)
    x = np.random.default_rng(1).normal(size=(400, 6))
    x[50:60] = x[0]
    df = spark.createDataFrame([(f"k{i:03}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "key string, v array<double>")
    got = {}
    for r in cluster.neighbours(df, 6, 3).collect():
        got.setdefault(r["key"], {})[r["place"]] = r["other"]
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 7)
    np.fill_diagonal(d, np.inf)
    for i in range(400):
        want = sorted(range(400), key=lambda j: (d[i, j], j))[:3]
        assert [got[f"k{i:03}"][p] for p in (1, 2, 3)] == [f"k{j:03}" for j in want]


def test_two_means(spark):
    x = np.random.default_rng(2).normal(size=(80, 4)) + np.repeat([[0], [9]], 40, 0)
    df = spark.createDataFrame([(f"k{i:02}", v.tolist()) for i, v in enumerate(x)], "key string, v array<double>")
    labels = {r["key"]: r["label"] for r in cluster.two_means(df, 4).collect()}
    assert {labels[f"k{i:02}"] for i in range(40)} == {0} and {labels[f"k{i:02}"] for i in range(40, 80)} == {1}
    scores = spark.createDataFrame([("k50", 0.2)], "key string, score double")
    kept, seen = cluster.filter_small_groups(df.where("key < 'k43'"), 4, scores.selectExpr("'k41' AS key", "score"), small=0.1)
    assert kept.count() == 40 and seen[0]["remove"] and not seen[-1]["remove"]
    assert cluster.two_means(df.limit(0), 4).count() == 0


def test_cut_and_spanning_tree_join_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LEAF_ROWS", 20)
    x = np.random.default_rng(9).normal(size=(150, 4))
    x[:20], x[20:40], x[40:60] = [1, 0, 0, 0], [0.9, 0, 0, 0], [9, 0, 0, 0]
    df = spark.createDataFrame([(f"k{i:03}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "key string, v array<double>")
    near = stage(cluster.neighbours(df, 4, 5), "test-near")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 2]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    label = np.arange(150)
    for _ in range(150):
        label = np.where(w <= 0.4, label[None], 150).min(1, initial=150, where=~np.eye(150, dtype=bool)).clip(max=label)
    alone = np.bincount(label, minlength=150)[label] < 2
    cut = cluster.density_cut(cluster.close_links(df, near, 4, 2, 0.4), df, 0.4, 2)
    got = {r["key"]: r["cluster"] for r in cut.collect()}
    assert [got[f"k{i:03}"] for i in range(150)] == ["noise" if alone[i] else f"k{label[i]:03}" for i in range(150)]
    assert got["k000"] == got["k039"] != got["k040"]
    tree = cluster.spanning_tree(df, near, 4, 5, 2).collect()
    inside, cost, total = np.zeros(150, dtype=bool), w[0].copy(), 0.0
    inside[0] = True
    for _ in range(149):
        i = np.where(inside, np.inf, cost).argmin()
        total, inside[i], cost = total + cost[i], True, np.minimum(cost, w[i])
    assert len(tree) == 149 and sum(r["w"] for r in tree) == pytest.approx(total)
    parts = merge_labels(spark.createDataFrame([(r["a"], r["b"]) for r in tree], "a string, b string")).select("root").distinct().count()
    assert parts == 1


def test_split_groups(spark):
    x = np.random.default_rng(4).normal(scale=0.01, size=(30, 3)) + np.eye(3)[np.arange(30) % 3]
    rows = [("b", f"k{i:02}", v.tolist()) for i, v in enumerate(x)] + [("c", "z", [1.0, 0.0, 0.0])]
    k = spark.createDataFrame([("b", 3), ("c", 2)], "grp string, k int")
    labels = {r["key"]: r["label"] for r in cluster.split_groups(spark.createDataFrame(rows, "grp string, key string, v array<double>"), k).collect()}
    assert len({labels[f"k{i:02}"] for i in range(30)}) == 3
    assert all(labels[f"k{i:02}"] == labels[f"k{i % 3:02}"] for i in range(30))


def test_split_groups_into_many(spark):
    angle = np.repeat(np.arange(600) * 2 * np.pi / 600, 2) + np.tile([0, 1e-5], 600)
    rows = [("b", f"k{i:04}", [math.cos(t), math.sin(t)]) for i, t in enumerate(angle)]
    k = spark.createDataFrame([("b", 600)], "grp string, k int")
    labels = {r["key"]: r["label"] for r in cluster.split_groups(spark.createDataFrame(rows, "grp string, key string, v array<double>"), k).collect()}
    assert len(set(labels.values())) == 600
    assert all(labels[f"k{i:04}"] == labels[f"k{i + 1:04}"] for i in range(0, 1200, 2))


def test_first_centres_are_farthest_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FIRST_ROWS", 20)
    monkeypatch.setattr(cluster, "LANE_ROWS", 50)
    x = np.random.default_rng(6).normal(size=(300, 4))
    x[100:140] = x[0]
    rows = spark.createDataFrame([("b", i % 6, f"k{i:03}", v.tolist(), float("inf")) for i, v in enumerate(x)], "grp string, lane int, key string, v array<double>, far double")
    groups = spark.createDataFrame([("b", 60, 300, 6)], "grp string, k int, n long, lanes int")
    got = [r["v"] for r in cluster._first_centres(rows, groups).orderBy("no").collect()]
    want, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(want) < 60:
        want.append(int(np.round(far, 12).argmax()))
        far = np.minimum(far, ((x - x[want[-1]]) ** 2).sum(1))
    assert got == x[want].tolist()


def test_correlation_and_encoder(spark):
    rng = np.random.default_rng(7)
    common = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 5))
    x, y = common + rng.normal(size=(300, 5)) * 0.3, common + rng.normal(size=(300, 5)) * 0.3
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    c = embed.cross_correlation(df, "x", "y", 5)
    zx, zy = ((v - v.mean(0)) / (v.std(0, ddof=1) + 1e-6) for v in (x, y))
    assert np.allclose(c, zx.T @ zy / 300)
    e = embed.fit_encoder(df, "x", "y", 5, 2)
    a, b = (x - e.mean) @ e.weights, (y - e.mean) @ e.weights
    assert all(np.corrcoef(a[:, j], b[:, j])[0, 1] > 0.8 for j in range(2))
    out = embed.encode(df.selectExpr("'k' AS key", "x"), "key", "x", e).first()["embedding"]
    assert math.isclose(sum(v * v for v in out), 1, rel_tol=1e-5)
    assert (embed.cross_correlation(df.limit(0), "x", "y", 5) == 0).all()


def test_principal_axes(spark):
    x = np.random.default_rng(8).normal(size=(200, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(f"k{i:03}", v.tolist()) for i, v in enumerate(x)], "key string, v array<double>")
    got = embed.project(df, "key", "v", embed.principal_axes(df, "v", 4)).orderBy("key").collect()
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(0)) @ axes[:, ::-1][:, :2]
    assert np.allclose(np.abs([[r["x"], r["y"]] for r in got]), np.abs(want))


def test_chimera(spark):
    rng = np.random.default_rng(9)
    rows = [("two", h, f"{h}.{i}", (np.eye(8)[0 if h == "h1" else 1] + rng.normal(scale=0.05, size=8)).tolist()) for h in ("h1", "h2") for i in range(5)]
    rows += [("one", h, f"o{h}.{i}", (np.ones(8) + rng.normal(scale=0.3, size=8)).tolist()) for h in ("h1", "h2") for i in range(5)]
    rows += [("half", "h1", "q", [1.0] * 8), ("half", None, "p", [1.0] * 8)]
    d = chimera.half_distances(spark.createDataFrame(rows, "contig string, half string, fragment string, v array<double>"))
    assert d.where("contig = 'two'").count() == 45
    got = {r["contig"]: r for r in chimera.chimera_test(d, permutations=200).collect()}
    assert set(got) == {"one", "two"} and got["two"]["is_chimera"] and not got["one"]["is_chimera"]
    p = [(r["kind"] == "between", r["distance"], r["first"], r["second"]) for r in d.where("contig = 'one'").collect()]

    def f(inner, outer):
        a, b = np.array(inner), np.array(outer)
        within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
        total = ((np.r_[a, b] - np.r_[a, b].mean()) ** 2).sum()
        return (total - within) / (within / (len(a) + len(b) - 2))

    seen = f([x[1] for x in p if not x[0]], [x[1] for x in p if x[0]])
    assert got["one"]["f"] == pytest.approx(seen)
    n, hits = sum(not x[0] for x in p), 0
    for perm in range(1, 201):
        order = sorted(p, key=lambda x: hashlib.md5(f"{x[2]}|{x[3]}|{perm}".encode()).hexdigest())
        hits += f([x[1] for x in order[:n]], [x[1] for x in order[n:]]) >= seen - 1e-9
    assert got["one"]["p"] == pytest.approx(hits / 200)


def test_best_line_ties_and_limits(spark):
    rows = [(1, "c", "F", 100, 0, 50, 5, 10), (0, "c", "F", 100, 0, 50, 5, 10), (2, "c", "F", 0, 0, 50, 5, 10), (3, "c", "G", 100, 0, 49, 9, 10), (4, "c", "H", 100, 0, 90, 5, 0)]
    df = spark.createDataFrame(rows, "line_no long, contig string, gene_family string, target_length int, target_start int, target_end int, matches int, alignment_length int")
    assert [tuple(r) for r in best_lines(scored_lines(df, 0.5, 0.5)).collect()] == [("c", "F", 0.25, 0)]


def test_duplicates_and_merge(spark):
    counts = spark.createDataFrame([("b", "F", 2), ("b", "G", 1), ("c", "F", 1)], "cluster string, gene_family string, contigs long")
    got = {r["cluster"]: r for r in duplicated_genes(counts).collect()}
    assert got["b"]["duplicated_genes"] == {"F": 2} and not got["c"]["has_duplications"] and got["c"]["duplicated_genes"] == {}
    bins = spark.createDataFrame([("1", "b"), ("2", "b"), ("3", "c"), ("4", "d")], "contig string, cluster string")
    refined = spark.createDataFrame([("1", "b_0", "b"), ("2", "b_1", "b"), ("3", "c_0", "c")], "contig string, cluster string, original_bin string")
    assert {(r["contig"], r["cluster"]) for r in merge_refined(bins, refined).collect()} == {("1", "b_0"), ("2", "b_1"), ("3", "c"), ("4", "d")}


def test_schedule():
    assert rules.learning_rate(0, 400, 1.0) == pytest.approx(0.1) and rules.learning_rate(10, 400, 1.0) == pytest.approx(1.0)
    assert rules.learning_rate(400, 400, 1.0) == pytest.approx(0.01)


def test_running_sums_over_split_contigs(spark):
    r = random.Random(8)
    points = [(s, c, p, r.randrange(-3, 4)) for s in "xy" for c in ("hot", "z") for p in sorted(r.sample(range(5000), 900 if c == "hot" else 3))]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(x["sample"], x["contig"], x["pos"]): x for x in running_depth(spark.createDataFrame(points, "sample string, contig string, pos int, change int")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = None
    for s, c, p, d in points:
        if key != (s, c):
            key, depth, area, square, last = (s, c), 0, 0, 0, None
        step = 0 if last is None else p - last
        area, square = area + step * depth, square + step * depth * depth
        x = got[s, c, p]
        assert (x["start"], x["before"], x["depth"], x["area"], x["square"]) == (last, depth, depth + d, area, square)
        depth, last = depth + d, p
    assert len(got) == len(points)


def test_coverage_by_name_then_first_word(spark):
    cover = spark.createDataFrame([("a", 1.0), ("a x", 2.0), ("b y", 3.0), ("b x", 4.0)], "contig string, coverage double")
    got = {r["contig"]: r["coverage"] for r in coverage_of_contigs(spark.createDataFrame([("a",), ("b",), ("c",)], "contig string"), cover).collect()}
    assert got == {"a": 1.0, "b": 4.0, "c": 0.0}


def test_join_by_key_deals_out_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 20)
    rows = [("hot", i) for i in range(300)] + [("b", 1), ("c", 2), (None, 3)]
    table = [("hot", "H"), ("b", "B"), (None, "N"), ("unused", "U")]
    df, dim = spark.createDataFrame(rows, "k string, n int"), spark.createDataFrame(table, "k string, v string")
    by = dict(table[:2])
    assert sorted(map(tuple, join_by_key(df, dim, "k").collect())) == sorted((k, n, by[k]) for k, n in rows if k in by)
    assert sorted(map(repr, map(tuple, join_by_key(df, dim, "k", "left").collect()))) == sorted(repr((k, n, by.get(k))) for k, n in rows)


def test_capped_pairs_are_a_fair_sample(spark):
    rows = [("big", f"m{i:03}") for i in range(60)] + [(f"g{j}", f"x{i}") for j in range(30) for i in range(3)] + [(f"p{j}", f"x{i}") for j in range(40) for i in range(2)]
    df = spark.createDataFrame(rows, "g string, m string")
    total = 60 * 59 // 2 + 30 * 3 + 40
    for cap in (5, 700, total - 50, total - 1):
        got = [tuple(r) for r in positive_pairs(df, "g", "m", cap).collect()]
        assert len(got) == len(set(got)) == cap and all(a < b for _, a, b in got)
    half = positive_pairs(df, "g", "m", 700).where("g = 'big'").collect()
    assert abs(len(half) - 700 * 1770 / total) < 2
    used = {m for r in half for m in (r["first"], r["second"])}
    assert len(used) == 60 and half != positive_pairs(df, "g", "m", 700, seed=1).where("g = 'big'").collect()


def test_shuffle_depends_on_the_seed_only(spark):
    df = spark.createDataFrame([("g", f"m{i}", f"n{i}") for i in range(50)], "g string, first string, second string")
    one, two = ([tuple(r) for r in shuffled(d, 1, "first", "second").collect()] for d in (df, df.repartition(3)))
    assert one == two and one != [tuple(r) for r in shuffled(df, 2, "first", "second").collect()] and sorted(one) != one


def test_too_many_fragments_of_a_half(spark, monkeypatch):
    monkeypatch.setattr(chimera, "MOST_FRAGMENTS", 3)
    rows = spark.createDataFrame([("c", "h1", f"f{i}", [1.0]) for i in range(4)], "contig string, half string, fragment string, v array<double>")
    with pytest.raises(ValueError, match="more than 3"):
        chimera.half_distances(rows)


def test_unit_forms_the_norm_once(spark):
    """Work in proportion to a vector's length, not to its square (1.3 billion steps here)."""
    rows = spark.range(20).select("id", F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda x: x * F.col("id")).alias("v"))
    began = time.time()
    got = {r["id"]: r["u"] for r in rows.select("id", rules.unit(F.col("v")).alias("u")).collect()}
    assert time.time() - began < 15
    want = np.arange(1, 8001) / np.sqrt((np.arange(1, 8001) ** 2).sum())
    assert got.pop(0) is None and len(got) == 19 and all(np.allclose(u, want, rtol=1e-12, atol=0) for u in got.values())


def test_neighbours_and_lightest_edges_with_many_copies(spark):
    """More copies of a vector than the lean way takes at once, ties by key, and edges as light as the bound."""
    r = np.random.default_rng(8)
    x = np.concatenate([np.repeat(r.normal(size=(1, 6)), 700, axis=0), r.normal(size=(300, 6))])
    x /= np.sqrt((x * x).sum(1))[:, None]
    x = x[r.permutation(len(x))]
    keys = [f"k{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "key string, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {(p["key"], p["place"]): p["other"] for p in cluster.neighbours(df, 6, 4).collect()}
    for i, key in enumerate(keys):
        order = [j for j in np.lexsort((np.arange(len(x)), np.round(d[i], 7))) if j != i][:4]
        assert [got[key, p] for p in (1, 2, 3, 4)] == [keys[j] for j in order]
    n = 40
    held = {"x": x[:n], "core": np.zeros(n), "tree_no": np.arange(n) // 4, "tree": np.arange(n) // 4, "key": np.array(keys[:n], dtype=object)}
    cut = d[:n, :n] + np.where((np.arange(n) // 4)[:, None] == (np.arange(n) // 4)[None], np.inf, 0)
    least = cut.min(1).reshape(-1, 4).min(1)
    met = cluster._lightest(held, held | {"bound": np.repeat(least, 4)}, [(0, np.arange(n), np.arange(n))])
    assert met.groupby("la")["w"].min().tolist() == pytest.approx(least.tolist(), abs=1e-12)
