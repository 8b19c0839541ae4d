import itertools

import numpy as np
import pytest

from strandbin.functions import dna
from strandbin.operators.classify import CLASSES
from strandbin.plans import catalogue, views
from tests.against_sql import FOLDER, check


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.SQL[name])


def _rows(spark, name):
    return [r.asDict() for r in catalogue.QUERIES[name](spark, FOLDER).collect()]


def _units(spark):
    v = {r["contig"]: np.array(r["v"]) for r in views.vectors(spark, FOLDER).collect()}
    return {k: x / np.sqrt((x * x).sum()) for k, x in sorted(v.items())}


def test_queries_without_sql_are_all_tested_here():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"mst_edges", "kmeans2_assign", "kmeans_filter_decision", "refine_kmeans", "refine_subbins", "refine_merge", "encoder_forward", "pca2", "augment_fragments", "feature_matrix", "class_scores"}


def test_spanning_tree_weighs_as_prims(spark):
    u = _units(spark)
    x = np.array(list(u.values()))
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, 2]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, cost, total = np.zeros(len(x), dtype=bool), w[0].copy(), 0.0
    inside[0] = True
    for _ in range(len(x) - 1):
        i = np.where(inside, np.inf, cost).argmin()
        total, inside[i], cost = total + cost[i], True, np.minimum(cost, w[i])
    got = _rows(spark, "mst_edges")
    assert len(got) == len(x) - 1 and sum(r["w"] for r in got) == pytest.approx(total, abs=1e-5 * len(x))


def test_two_means_of_the_table(spark):
    u = _units(spark)
    keys, x = list(u), np.array(list(u.values()))
    centres = np.array([x[0], x[max(range(len(x)), key=lambda i: (np.sqrt(((x[i] - x[0]) ** 2).sum()), keys[i]))]])
    for _ in range(10):
        at = (((x - centres[1]) ** 2).sum(1) < ((x - centres[0]) ** 2).sum(1)).astype(int)
        centres = np.array([x[at == j].mean(0) for j in (0, 1)])
    at = (((x - centres[1]) ** 2).sum(1) < ((x - centres[0]) ** 2).sum(1)).astype(int)
    assert {r["contig"]: r["label"] for r in _rows(spark, "kmeans2_assign")} == dict(zip(keys, at))
    seen = _rows(spark, "kmeans_filter_decision")[0]
    scores = {r["contig"]: r["eukaryotic"] for r in views.scores(spark, FOLDER).collect()}
    small = 0 if (at == 0).sum() < (at == 1).sum() else 1
    own = [scores[k] for k, j in zip(keys, at) if j == small and k in scores]
    assert (seen["contigs"], seen["small_contigs"], seen["scored"], seen["sure"]) == (len(x), (at == small).sum(), len(own), sum(s >= 0.95 for s in own))
    assert seen["removed"] == (seen["small_contigs"] <= 0.05 * len(x) and len(own) > 0 and not seen["sure"])


def test_refinement_of_the_table(spark):
    refined = _rows(spark, "refine_kmeans")
    targets = {r["cluster"]: r["k"] for r in _rows(spark, "refine_eligibility") if r["status"] == "eligible"}
    bins = {r["contig"]: r["cluster"] for r in views.bins(spark, FOLDER).collect()}
    u = _units(spark)
    assert {r["contig"] for r in refined} == {c for c, b in bins.items() if b in targets and c in u}
    assert all(bins[r["contig"]] == r["original_bin"] and r["cluster"].startswith(r["original_bin"] + "_refined_bin_") for r in refined)
    for name, k in targets.items():
        own = [c for c in sorted(u) if bins.get(c) == name]
        x = np.array([u[c] for c in own])
        chosen, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < k and np.round(far, 12).max() > 0:
            chosen.append(int(np.round(far, 12).argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        centre = x[chosen]
        for _ in range(5):
            at = np.round(((x[:, None] - centre[None]) ** 2).sum(2), 12).argmin(1)
            centre = np.array([x[at == j].mean(0) if (at == j).any() else np.full(x.shape[1], 9.0) for j in range(len(centre))])
        at = np.round(((x[:, None] - centre[None]) ** 2).sum(2), 12).argmin(1)
        parts = {}
        for c, j in zip(own, at):
            parts.setdefault(j, set()).add(c)
        found = {}
        for r in refined:
            if r["original_bin"] == name:
                found.setdefault(r["cluster"], set()).add(r["contig"])
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, found.values()))
    subs = {r["original_bin"]: r for r in _rows(spark, "refine_subbins")}
    assert {b: r["contigs"] for b, r in subs.items()} == {b: sum(r["original_bin"] == b for r in refined) for b in {r["original_bin"] for r in refined}}
    assert all(r["still_duplicated"] <= r["sub_bins"] <= targets[b] for b, r in subs.items())
    merged = {r["contig"]: (r["cluster"], r["original_bin"]) for r in _rows(spark, "refine_merge")}
    split = {b for b, r in subs.items() if r["sub_bins"] > 1}
    new = {r["contig"]: (r["cluster"], r["original_bin"]) for r in refined if r["original_bin"] in split}
    assert merged == {c: (b, None) for c, b in bins.items() if b not in split} | new


def test_feature_matrix_of_the_table(spark):
    seqs = {}
    for name in ("fragments_dict", "control_contigs"):
        for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").where("sequence is not null").collect():
            seqs[r["contig"]] = max(r["sequence"], seqs.get(r["contig"], ""))
    spans = {r["fragment"]: (r["contig"], r["start"], r["end"]) for r in catalogue.QUERIES["frag_clamp"](spark, FOLDER).where("valid").collect()}
    covered = {r["fragment"] for r in _rows(spark, "coverage_zscore")}
    index = dna.canonical_index(4, dna.PROFILE_ALPHABET)
    got = _rows(spark, "feature_matrix")
    assert {r["fragment"] for r in got} == covered & set(spans)
    for r in got[:: max(1, len(got) // 40)]:
        contig, start, end = spans[r["fragment"]]
        counts = np.zeros(136)
        piece = seqs[contig][start:end].upper()
        for p in range(len(piece) - 3):
            if set(piece[p : p + 4]) <= set("ACGT"):
                counts[index[sum("ACGT".index(c) * 4 ** (3 - j) for j, c in enumerate(piece[p : p + 4]))]] += 1
        assert [r[f"kmer_{i}"] for i in range(136)] == pytest.approx((counts + 1e-5) / (counts.sum() + 136e-5), abs=1e-6)


def test_embeddings_projection_and_scores_of_the_table(spark):
    vectors = _rows(spark, "encoder_forward")
    known = views.fragments(spark, FOLDER).select("fragment")  # those whose contig is known
    whole = spark.read.parquet(f"{FOLDER}/features.parquet").where("fragment like '%.original' and kmer is not null").join(known, "fragment", "left_semi").select("fragment").distinct()
    assert len(vectors) == whole.count() and all(sum(x * x for x in r["embedding"]) == pytest.approx(1, abs=1e-5) for r in vectors)
    u = _units(spark)
    x = np.array(list(u.values()))
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    want = np.abs((x - x.mean(0)) @ axes[:, ::-1][:, :2])
    got = {r["contig"]: r for r in _rows(spark, "pca2")}
    assert np.allclose([[abs(got[c]["x"]), abs(got[c]["y"])] for c in u], want, atol=1e-5)
    scores = _rows(spark, "class_scores")
    assert len(scores) == views.contigs(spark, FOLDER).count()
    assert all(sum(r[c] for c in CLASSES) == pytest.approx(1, abs=1e-5) for r in scores)


def test_augmentation_of_the_table(spark):
    sizes = {r["contig"]: r["length"] for r in views.lengths(spark, FOLDER).collect() if r["length"] >= 1000}
    rows = _rows(spark, "augment_fragments")
    assert {r["contig"] for r in rows} == set(sizes) and sum(r["kind"] == "original" for r in rows) == len(sizes)
    groups = {}
    for r in rows:
        n = sizes[r["contig"]]
        low, high = {"h1": (0, n // 2), "h2": (n // 2, n), None: (0, n)}[r["half"]]
        assert (n > 10_000) == (r["half"] is not None) or r["kind"] == "original"
        assert r["length"] >= 1000 and low <= r["start_pos"] and r["start_pos"] + r["length"] <= high
        if r["kind"] == "aug":
            groups.setdefault((r["contig"], r["half"]), []).append(r)
    for own in groups.values():
        assert len(own) <= 8
        for a, b in itertools.combinations(own, 2):
            common = max(0, min(a["start_pos"] + a["length"], b["start_pos"] + b["length"]) - max(a["start_pos"], b["start_pos"]))
            assert common < 0.25 * max(a["length"], b["length"])


def test_every_contig_is_member_of_a_group(spark):
    rows = [(r["cluster"], r["row_no"]) for r in catalogue.QUERIES["cluster_members"](spark, FOLDER).collect()]
    sizes = {r["cluster"]: r["contigs"] for r in catalogue.QUERIES["cluster_counts"](spark, FOLDER).collect()}
    assert "noise" in sizes and sorted(rows) == sorted((c, i) for c, n in sizes.items() for i in range(n))
