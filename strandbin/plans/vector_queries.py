"""Queries over vectors: distances, embedding, clustering, split contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbin.functions import rules
from strandbin.operators import chimera as ch
from strandbin.operators import cluster as cl
from strandbin.operators import embed as em
from strandbin.operators.fragments import augment_fragments as augment
from strandbin.operators.fragments import positive_pairs
from strandbin.operators.sums import mean_vectors
from strandbin.plans import views as v
from strandbin.plans.views import with_views
from strandbin.runtime import stage, table

WIDTH, KMERS, K, NEAR, EPSILON, LEAST = 48, 136, 2, 5, 0.4, 2


def l2_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return v.vectors(spark, folder).select("contig", F.posexplode(rules.unit(F.col("v"))).alias("place", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


def _next_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector of ``embeddings`` with the next."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


def cosine_distance(spark: SparkSession, folder: str) -> DataFrame:
    return _next_vectors(spark, folder).select("vec_id", F.round(rules.cosine_distance(F.col("v"), F.col("w")), 6).alias("distance"))


def euclidean_distance(spark: SparkSession, folder: str) -> DataFrame:
    return _next_vectors(spark, folder).select("vec_id", F.round(rules.euclidean(F.col("v"), F.col("w")), 6).alias("distance"))


def _unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Written once, as several steps of a query read them."""
    return stage(v.vectors(spark, folder).select(F.col("contig").alias("key"), rules.unit(F.col("v")).alias("v")), "unit-vectors")


def _near(spark: SparkSession, folder: str) -> DataFrame:
    return cl.neighbours(_unit_vectors(spark, folder), WIDTH, NEAR)


def core_distance(spark: SparkSession, folder: str) -> DataFrame:
    return cl.core_distances(_near(spark, folder), K).select(F.col("key").alias("contig"), F.round("core", 6).alias("core"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    near = _near(spark, folder)
    return cl.mutual_reachability(near, cl.core_distances(near, K))


def mutual_reach(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).withColumn("w", F.round("w", 6))


def mst_edges(spark: SparkSession, folder: str) -> DataFrame:
    """A minimum spanning tree of the whole mutual reachability graph."""
    rows = _unit_vectors(spark, folder)
    near = stage(cl.neighbours(rows, WIDTH, NEAR), "mst-near")
    return cl.spanning_tree(rows, near, WIDTH, NEAR, K).withColumn("w", F.round("w", 6))


def hdbscan_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the whole mutual reachability graph, cut at one distance."""
    rows = _unit_vectors(spark, folder)
    near = stage(cl.neighbours(rows, WIDTH, NEAR), "cut-near")
    return cl.density_cut(cl.close_links(rows, near, WIDTH, K, EPSILON), rows, EPSILON, LEAST).withColumnRenamed("key", "contig")


def kmeans2_assign(spark: SparkSession, folder: str) -> DataFrame:
    return cl.two_means(_unit_vectors(spark, folder), WIDTH).select(F.col("key").alias("contig"), "label")


def kmeans_filter_decision(spark: SparkSession, folder: str) -> DataFrame:
    """What each round of the small-group filter saw and decided."""
    scores = v.scores(spark, folder).select(F.col("contig").alias("key"), F.col("eukaryotic").alias("score"))
    _, seen = cl.filter_small_groups(_unit_vectors(spark, folder), WIDTH, scores)
    rows = [(i, r["rows"], r["small_rows"], r["scored"], r["sure"], r["remove"]) for i, r in enumerate(seen)]
    return spark.createDataFrame(rows, "round int, contigs long, small_contigs long, scored long, sure long, removed boolean")


def _fragment_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """k-mer vectors of fragments with their contig and half, each fragment once."""
    f = table(spark, folder, "features").where("kmer is not null").groupBy("fragment").agg(F.max("kmer").alias("v"))
    return f.join(v.fragments(spark, folder).select("fragment", "contig", "half").distinct(), "fragment")


def half_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = _fragment_vectors(spark, folder).where("half is not null")
    return rows.groupBy("contig", "half").agg(F.count(F.lit(1)).alias("fragments"))


def half_centroids(spark: SparkSession, folder: str) -> DataFrame:
    means = mean_vectors(_fragment_vectors(spark, folder).where("half is not null"), ["contig", "half"], "v")
    return means.select("contig", "half", F.posexplode("mean").alias("place", "value")).withColumn("value", F.round("value", 6))


def chimera_distances(spark: SparkSession, folder: str) -> DataFrame:
    return ch.half_distances(_fragment_vectors(spark, folder)).withColumn("distance", F.round("distance", 6))


def chimera_fstat(spark: SparkSession, folder: str) -> DataFrame:
    return ch.chimera_statistics(ch.half_distances(_fragment_vectors(spark, folder))).withColumn("f", F.round("f", 4))


def chimera_test(spark: SparkSession, folder: str) -> DataFrame:
    found = ch.chimera_test(ch.half_distances(_fragment_vectors(spark, folder)))
    return found.select("contig", F.round("f", 4).alias("f"), F.round("p", 6).alias("p"), "is_chimera")


def _vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """k-mer vectors of the positive pairs of fragments, as the encoder trains on."""
    rows = _fragment_vectors(spark, folder)
    pairs = positive_pairs(rows, "contig", "fragment", 5_000_000)
    kmers = rows.select("fragment", "v").dropDuplicates(["fragment"])
    return pairs.join(kmers.select(F.col("fragment").alias("first"), "v"), "first").join(kmers.select(F.col("fragment").alias("second"), F.col("v").alias("w")), "second")


def barlow_crosscorr(spark: SparkSession, folder: str) -> DataFrame:
    c = em.cross_correlation(_vector_pairs(spark, folder), "v", "w", KMERS)
    rows = [(i, j, round(float(c[i, j]), 6) + 0.0) for i in range(KMERS) for j in range(KMERS)]
    return spark.createDataFrame(rows, "i int, j int, c double")


def barlow_loss(spark: SparkSession, folder: str) -> DataFrame:
    c = em.cross_correlation(_vector_pairs(spark, folder), "v", "w", KMERS)
    return spark.createDataFrame([(round(em.redundancy_loss(c), 4),)], "loss double")


def encoder_forward(spark: SparkSession, folder: str) -> DataFrame:
    """An encoder fitted to pairs of fragments of one contig; embeddings of all whole contigs."""
    rows = _fragment_vectors(spark, folder)
    pairs = positive_pairs(rows, "contig", "fragment", 5_000_000)
    kmers = rows.select("fragment", "v").dropDuplicates(["fragment"])
    views = pairs.join(kmers.select(F.col("fragment").alias("first"), F.col("v").alias("x")), "first").join(kmers.select(F.col("fragment").alias("second"), F.col("v").alias("y")), "second")
    encoder = em.fit_encoder(views, "x", "y", KMERS, 32)
    return em.encode(rows.where("half is null and fragment like '%.original'"), "contig", "v", encoder).select("contig", "embedding")


def pca2(spark: SparkSession, folder: str) -> DataFrame:
    rows = _unit_vectors(spark, folder)
    found = em.project(rows, "key", "v", em.principal_axes(rows, "v", WIDTH))
    return found.select(F.col("key").alias("contig"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def augment_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return augment(v.lengths(spark, folder), 1_000, split=10_000)


QUERIES = {f.__name__: f for f in (l2_normalise, cosine_distance, euclidean_distance, core_distance, mutual_reach, mst_edges, hdbscan_labels, kmeans2_assign, kmeans_filter_decision, half_groups, half_centroids, chimera_distances, chimera_fstat, chimera_test, barlow_crosscorr, barlow_loss, encoder_forward, pca2, augment_fragments)}

_NEXT = "n AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_NEAR = f"""u AS (SELECT contig AS key, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM vecs),
        near AS (SELECT a.key, b.key AS other, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.key ORDER BY round(list_distance(a.v, b.v), 7), b.key) AS place FROM u a JOIN u b ON a.key <> b.key QUALIFY place <= {NEAR}),
        core AS (SELECT key, d AS core FROM near WHERE place = {K}),
        edges AS (SELECT a, b, greatest(d, x.core, y.core) AS w FROM (SELECT least(key, other) AS a, greatest(key, other) AS b, min(d) AS d FROM near GROUP BY ALL) JOIN core x ON x.key = a JOIN core y ON y.key = b)"""
_FV = "fv AS (SELECT fragment, contig, half, v FROM (SELECT fragment, max(kmer) AS v FROM features WHERE kmer IS NOT NULL GROUP BY fragment) JOIN (SELECT DISTINCT fragment, contig, half FROM frags) USING (fragment))"
_DIST = f"""{_FV}, dist AS (SELECT a.contig, CASE WHEN a.half = b.half THEN a.half ELSE 'between' END AS kind, a.fragment AS first, b.fragment AS second, list_cosine_distance(a.v, b.v) AS distance
            FROM fv a JOIN fv b ON a.contig = b.contig AND (a.half, a.fragment) < (b.half, b.fragment) WHERE a.half IN ('h1', 'h2') AND b.half IN ('h1', 'h2'))"""
_CORR = f"""{_FV}, p AS (SELECT a.fragment AS first, b.fragment AS second, a.v, b.v AS w FROM fv a JOIN fv b ON a.contig = b.contig AND a.fragment < b.fragment),
        d AS (SELECT unnest(range({KMERS})) AS i, unnest(v) AS x, unnest(w) AS y FROM p), m AS (SELECT i, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_samp(x) + 1e-6 AS sx, stddev_samp(y) + 1e-6 AS sy FROM d GROUP BY i),
        ms AS (SELECT list(mx ORDER BY i) AS mx, list(my ORDER BY i) AS my, list(sx ORDER BY i) AS sx, list(sy ORDER BY i) AS sy FROM m),
        z AS (SELECT list_transform(v, lambda x, k: (x - mx[k]) / sx[k]) AS x, list_transform(w, lambda y, k: (y - my[k]) / sy[k]) AS y FROM p, ms),
        c AS (SELECT i, j, avg(x[i + 1] * y[j + 1]) AS c FROM z, range({KMERS}) a(i), range({KMERS}) b(j) GROUP BY i, j)"""

SQL = {
    "l2_normalise": with_views("vecs", "SELECT contig, unnest(range(48))::INT AS place, round(unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) + 0.0 AS value FROM vecs"),
    "cosine_distance": f"WITH {_NEXT} SELECT vec_id, round(list_cosine_distance(v, w), 6) AS distance FROM n",
    "euclidean_distance": f"WITH {_NEXT} SELECT vec_id, round(list_distance(v, w), 6) AS distance FROM n",
    "core_distance": with_views("vecs", f", {_NEAR} SELECT key AS contig, round(core, 6) AS core FROM core"),
    "mutual_reach": with_views("vecs", f", {_NEAR} SELECT a, b, round(w, 6) AS w FROM edges"),
    "hdbscan_labels": with_views("vecs", f""", {_NEAR}, links AS (SELECT a, b FROM edges WHERE w <= {EPSILON} UNION ALL SELECT b, a FROM edges WHERE w <= {EPSILON}),
        reach(key, root) USING KEY (key) AS (SELECT a, least(a, min(b)) FROM links GROUP BY a
            UNION SELECT l.a, min(r.root) FROM links l JOIN reach r ON r.key = l.b JOIN recurring.reach own ON own.key = l.a WHERE r.root < own.root GROUP BY l.a)
        SELECT u.key AS contig, coalesce(r.root, 'noise') AS cluster FROM u LEFT JOIN reach r ON r.key = u.key""", recursive=True),
    "half_groups": with_views("frags", f", {_FV} SELECT contig, half, count(*) AS fragments FROM fv WHERE half IS NOT NULL GROUP BY ALL"),
    "half_centroids": with_views("frags", f", {_FV} SELECT contig, half, i::INT AS place, round(avg(x), 6) AS value FROM (SELECT contig, half, unnest(range(136)) AS i, unnest(v) AS x FROM fv WHERE half IS NOT NULL) GROUP BY ALL"),
    "chimera_distances": with_views("frags", f", {_DIST} SELECT contig, kind, first, second, round(distance, 6) AS distance FROM dist"),
    "chimera_fstat": with_views("frags", f""", {_DIST}, g AS (SELECT contig, count(*) FILTER (kind <> 'between') AS within, count(*) FILTER (kind = 'between') AS between,
            avg(distance) AS m, avg(distance) FILTER (kind <> 'between') AS m1, avg(distance) FILTER (kind = 'between') AS m2 FROM dist GROUP BY contig HAVING within > 0 AND between > 0),
        s AS (SELECT contig, sum((distance - CASE WHEN kind = 'between' THEN m2 ELSE m1 END) ** 2) AS w FROM dist JOIN g USING (contig) GROUP BY contig)
        SELECT contig, within, between, round(CASE WHEN within + between > 2 AND w > 1e-12 THEN (within * (m1 - m) ** 2 + between * (m2 - m) ** 2) / (w / (within + between - 2)) ELSE 0 END, 4) AS f FROM g JOIN s USING (contig)"""),
    "chimera_test": with_views("frags", f""", {_DIST}, g AS (SELECT contig, count(*) FILTER (kind <> 'between') AS n1, count(*) FILTER (kind = 'between') AS n2,
            avg(distance) AS m, avg(distance) FILTER (kind <> 'between') AS m1, avg(distance) FILTER (kind = 'between') AS m2, sum(distance * distance) AS sq FROM dist GROUP BY contig HAVING n1 > 0 AND n2 > 0),
        seen AS (SELECT contig, CASE WHEN n1 + n2 > 2 AND sq - n1 * m1 * m1 - n2 * m2 * m2 > 1e-12 THEN (n1 * (m1 - m) ** 2 + n2 * (m2 - m) ** 2) / ((sq - n1 * m1 * m1 - n2 * m2 * m2) / (n1 + n2 - 2)) ELSE 0 END AS f FROM g),
        drawn AS (SELECT contig, perm, distance, row_number() OVER (PARTITION BY contig, perm ORDER BY md5(first || '|' || second || '|' || perm)) AS place FROM dist SEMI JOIN g USING (contig), (SELECT unnest(range(1, 1001)) AS perm)),
        h AS (SELECT contig, perm, avg(distance) FILTER (place <= n1) AS m1, avg(distance) FILTER (place > n1) AS m2 FROM drawn JOIN g USING (contig) GROUP BY contig, perm),
        fs AS (SELECT contig, perm, CASE WHEN n1 + n2 > 2 AND sq - n1 * h.m1 * h.m1 - n2 * h.m2 * h.m2 > 1e-12 THEN (n1 * (h.m1 - m) ** 2 + n2 * (h.m2 - m) ** 2) / ((sq - n1 * h.m1 * h.m1 - n2 * h.m2 * h.m2) / (n1 + n2 - 2)) ELSE 0 END AS f FROM h JOIN g USING (contig))
        SELECT contig, round(any_value(seen.f), 4) AS f, round(avg((fs.f >= seen.f - 1e-9)::INT), 6) AS p, avg((fs.f >= seen.f - 1e-9)::INT) < 0.05 AS is_chimera FROM fs JOIN seen USING (contig) GROUP BY contig"""),
    "barlow_crosscorr": with_views("frags", f", {_CORR} SELECT i::INT AS i, j::INT AS j, round(c, 6) + 0.0 AS c FROM c"),
    "barlow_loss": with_views("frags", f", {_CORR} SELECT round(sum(CASE WHEN i = j THEN (c - 1) ** 2 ELSE 5e-3 * c ** 2 END), 4) AS loss FROM c"),
}
