"""The whole run: contigs, reads or coverage, class scores and alignment lines in; bins out."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbin.operators import chimera as ch
from strandbin.operators import cluster as cl
from strandbin.operators import coverage as co
from strandbin.operators import embed as em
from strandbin.operators import quality as q
from strandbin.operators.classify import bacterial_filter
from strandbin.operators.fragments import augment_fragments, positive_pairs
from strandbin.operators.kmers import kmer_profiles
from strandbin.operators.skew import join_by_key
from strandbin.params import Params
from strandbin.runtime import stage
from strandbin.sources.fasta import write_fasta
from strandbin.sources.tables import write_scores

KMERS = 136


@dataclass
class Result:
    """``bins`` and ``quality`` are the outcome; the others are written where intermediate results are kept."""

    bins: DataFrame
    quality: DataFrame
    kept: DataFrame
    params: Params
    chimeras: DataFrame | None = None
    scores: DataFrame | None = None
    fragments: DataFrame | None = None
    features: DataFrame | None = None
    embeddings: DataFrame | None = None
    encoder: DataFrame | None = None
    coordinates: DataFrame | None = None
    duplications: DataFrame | None = None
    filter_rounds: list[dict] = field(default_factory=list)
    refinement_rounds: list[dict] = field(default_factory=list)


def _coverage(frags: DataFrame, sized: DataFrame, alignments: DataFrame | None, cover: DataFrame | None, samples: tuple[str, ...]) -> tuple[DataFrame | None, list[str]]:
    """Coverage columns of fragments, log-scaled and standardised, and their names; fragments without any are left out.

    Reads give mean and deviation of each sample, scaled by its reads; a table gives its number to all fragments of a contig.
    """
    if alignments is not None:
        columns = [f"{s}_coverage{x}" for s in samples for x in ("", "_std")]
        rpm = co.per_million(co.fragment_coverage(alignments, co.clamp_fragments(frags, sized), samples), co.reads_per_sample(alignments))
        wide = co.pivot_samples(rpm, samples)
    elif cover is not None:
        columns = [f"{s}_coverage" for s in samples]
        wide = sized.select("contig")
        for s, c in zip(samples, columns):
            own = co.coverage_of_contigs(sized.select("contig"), cover.where(F.col("sample") == s).select("contig", "coverage"))
            wide = wide.join(own.withColumnRenamed("coverage", c), "contig")
        wide = join_by_key(frags.select("fragment", "contig"), wide, "contig").drop("contig")
    else:
        return None, []
    wide = stage(wide.where(co.any_coverage(columns)).withColumns({c: F.log1p(c) for c in columns}), "run-coverage")
    return co.standardised(wide, columns), columns


def features(contigs: DataFrame, alignments: DataFrame | None, cover: DataFrame | None, samples: tuple[str, ...], p: Params) -> tuple[DataFrame, DataFrame, int]:
    """Fragments (``fragment, contig, kind, half, ordinal, start_pos, length``), their vectors (``fragment, v``), their width.

    A vector is the k-mer profile followed by the scaled coverage of each sample. Fragments without coverage have none.
    """
    sized = contigs.select("contig", F.length("seq").alias("length"))
    frags = augment_fragments(sized, p.min_contig_length, p.num_augmentations)
    name = F.concat_ws(".", "contig", F.when(F.col("kind") == "original", "original").otherwise(F.concat_ws(".", "half", F.col("ordinal").cast("string"))))
    frags = stage(frags.withColumn("fragment", name), "run-fragments")
    # A contig's spans, few by construction, meet its sequence as one row.
    spans = frags.groupBy("contig").agg(F.collect_list(F.struct("fragment", "start_pos", "length")).alias("spans"))
    cut = contigs.join(spans, "contig").select("seq", F.explode("spans").alias("f"))
    shares = kmer_profiles(cut.select("f.fragment", F.expr("substring(seq, f.start_pos + 1, f.length)").alias("piece")), "fragment", "piece")
    scaled, columns = _coverage(frags, sized, alignments, cover, samples)
    if scaled is None:
        return frags, stage(shares.select("fragment", F.col("profile").alias("v")), "run-vectors"), KMERS
    vectors = shares.join(scaled, "fragment").select("fragment", F.concat("profile", F.array(*columns)).alias("v"))
    return frags, stage(vectors, "run-vectors"), KMERS + len(columns)


def _clustered(embedded: DataFrame, p: Params) -> DataFrame:
    """``contig, cluster``. If there is exactly one cluster, a larger least size is tried, and taken if it gives more."""
    near = stage(cl.neighbours(embedded, p.embedding_dim, max(5, p.core_neighbour)), "run-near")
    links = stage(cl.close_links(embedded, near, p.embedding_dim, p.core_neighbour, p.cluster_selection_epsilon), "run-links")
    found = None
    for least in (p.min_cluster_size, p.min_cluster_size + 1):
        bins = cl.density_cut(links, embedded, p.cluster_selection_epsilon, least)
        bins = stage(bins.select(F.col("key").alias("contig"), "cluster"), "run-bins")
        number = bins.where(F.col("cluster") != cl.NOISE).select("cluster").distinct().limit(2).count()
        found = bins if found is None or number > 1 else found
        if number != 1:
            break
    return found


def _quality(bins: DataFrame, lines: DataFrame, coverage: float, identity: float) -> tuple[DataFrame, DataFrame]:
    dup = stage(q.duplicated_genes(q.family_counts(bins, q.best_lines(q.scored_lines(lines, coverage, identity)))), "run-duplicates")
    return q.annotated(bins, dup), dup


def _chimeras(frags: DataFrame, vectors: DataFrame, encoder: em.Encoder, bins: DataFrame, embedded: DataFrame) -> DataFrame:
    """The test of each contig with both halves and an embedding, with its bin and the ratio of its halves' fragments."""
    halves = frags.where("half is not null").select("fragment", "contig", "half").join(embedded.select(F.col("key").alias("contig")), "contig", "left_semi")
    encoded = em.encode(halves.join(vectors, "fragment"), "fragment", "v", encoder, normalise=False)
    tested = ch.chimera_test(ch.half_distances(encoded.join(halves, "fragment").withColumnRenamed("embedding", "v")))
    n = halves.groupBy("contig").agg(F.count_if(F.col("half") == "h1").alias("h1"), F.count_if(F.col("half") == "h2").alias("h2"))
    ratio = (F.least("h1", "h2") / F.greatest("h1", "h2")).alias("count_ratio")
    return tested.join(n.select("contig", "h1", "h2", ratio), "contig").join(bins, "contig", "left")


def run(contigs: DataFrame, alignments: DataFrame | None, samples: tuple[str, ...], lines: DataFrame | None, scores: DataFrame | None = None, p: Params = Params(), cover: DataFrame | None = None) -> Result:
    """``contigs`` has ``contig, seq``, each contig once; ``alignments`` ``sample, contig, start, end``, or in their place
    ``cover`` ``sample, contig, coverage``, or neither; ``samples`` their names in order; ``lines`` protein alignments with
    ``gene_family``; ``scores`` the four class scores. Without scores no contig is filtered, without lines no bin is flagged.
    """
    if alignments is not None and cover is not None:
        raise ValueError("reads or a coverage table, not both")
    kept = contigs.where(F.length("seq") >= p.min_contig_length)
    if scores is not None and not p.skip_bacterial_filter:
        known = kept.join(bacterial_filter(scores.join(kept.select("contig"), "contig", "left_semi")).select("contig"), "contig", "left_semi")
        kept = known.unionByName(kept.join(scores.select("contig"), "contig", "left_anti"))
    kept = stage(kept, "run-contigs")
    frags, vectors, width = features(kept, alignments, cover, samples, p)
    members = frags.select("fragment", "contig").join(vectors, "fragment")
    pairs = positive_pairs(members, "contig", "fragment", p.max_positive_pairs)
    views = pairs.join(vectors.select(F.col("fragment").alias("first"), F.col("v").alias("x")), "first").join(vectors.select(F.col("fragment").alias("second"), F.col("v").alias("y")), "second")
    encoder = em.fit_encoder(views, "x", "y", width, p.embedding_dim)
    whole = frags.where("kind = 'original'").select("fragment", "contig").join(vectors, "fragment")
    embedded = em.encode(whole, "contig", "v", encoder).select(F.col("contig").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    every = embedded = stage(embedded, "run-embedding")
    rounds: list[dict] = []
    if scores is not None and not p.skip_kmeans_filtering:
        embedded, rounds = cl.filter_small_groups(embedded, p.embedding_dim, scores.select(F.col("contig").alias("key"), F.col("eukaryotic").alias("score")))
        embedded = stage(embedded, "run-filtered")
    bins = _clustered(embedded, p)
    if lines is None:
        lines = kept.sparkSession.createDataFrame([], "line_no long, contig string, gene_family string, target_length int, target_start int, target_end int, matches int, alignment_length int")
    quality, dup = _quality(bins, lines, 0.5, 0.5)
    refinement: list[dict] = []
    for number in range(0 if p.skip_refinement else p.max_refinement_rounds):
        targets = stage(q.refinement_targets(quality, dup).where("status = 'eligible'"), "run-targets")
        if not targets.limit(1).count():
            break
        rows = bins.join(targets.select("cluster"), "cluster", "left_semi").join(embedded.withColumnRenamed("key", "contig"), "contig")
        split = cl.split_groups(rows.select(F.col("cluster").alias("grp"), F.col("contig").alias("key"), "v"), targets.select(F.col("cluster").alias("grp"), "k"))
        refined = split.select(F.col("key").alias("contig"), F.concat("grp", F.lit("_refined_bin_"), F.col("label").cast("string")).alias("cluster"), F.col("grp").alias("original_bin"))
        merged = stage(q.merge_refined(bins, refined), f"run-bins-{number}")
        made = merged.where("original_bin is not null").agg(F.countDistinct("original_bin").alias("bins"), F.countDistinct("cluster").alias("sub_bins")).first()
        refinement.append({"round": number + 1, "eligible": targets.count(), "split": made["bins"], "sub_bins": made["sub_bins"]})
        bins = merged.select("contig", "cluster")
        quality, dup = _quality(bins, lines, 0.6, 0.4)
    sizes = q.bin_sizes(bins, kept.select("contig", F.length("seq").alias("length")), p.min_bin_size)
    final = stage(bins.join(sizes.select("cluster"), "cluster", "left_semi").select("contig", "cluster"), "run-final")
    result = Result(final, quality, kept, p, scores=scores, filter_rounds=rounds, refinement_rounds=refinement)
    if p.enable_chimera_detection:
        result.chimeras = _chimeras(frags, vectors, encoder, bins, every)
    if p.keep_intermediate:
        result.fragments, result.features, result.embeddings, result.duplications = frags, vectors, every.withColumnRenamed("key", "contig"), dup
        result.encoder = kept.sparkSession.createDataFrame([("mean", 0, encoder.mean.tolist()), *[("weights", i, w.tolist()) for i, w in enumerate(encoder.weights.T)]], "part string, row int, v array<double>")
        placed = em.project(every, "key", "v", em.principal_axes(every, "v", p.embedding_dim)).withColumnRenamed("key", "contig")
        result.coordinates = placed.join(bins, "contig", "left").na.fill(cl.NOISE, ["cluster"])
    return result


def write(result: Result, path: str) -> None:
    """``bins.csv`` (a folder of parts), ``quality``, and a folder of FASTA text per bin; flagged bins are named so.

    Kept intermediate results: contigs after the filter as FASTA, class scores, fragments, features, embeddings, encoder,
    coordinates for a plot, duplicated genes, and the parameters and rounds as JSON.
    """
    spark = result.bins.sparkSession
    result.bins.write.mode("overwrite").option("header", True).csv(f"{path}/bins.csv")
    result.quality.write.mode("overwrite").parquet(f"{path}/quality")
    flags = result.quality.groupBy("cluster").agg(F.max("has_duplicated_core_genes").alias("flag"))
    named = result.bins.join(flags, "cluster", "left").withColumn("bin", F.concat("cluster", F.when(F.col("flag"), "_duplicated_core_genes").otherwise("")))
    write_fasta(result.kept.join(named.select("contig", "bin"), "contig"), f"{path}/bins", "contig", "seq", "bin")
    if result.chimeras is not None:
        result.chimeras.write.mode("overwrite").json(f"{path}/chimeras")
    if not result.params.keep_intermediate:
        return
    write_fasta(result.kept, f"{path}/filtered", "contig", "seq")
    if result.scores is not None:
        write_scores(result.scores, f"{path}/scores")
    for name in ("fragments", "features", "embeddings", "encoder", "coordinates"):
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
    result.duplications.write.mode("overwrite").json(f"{path}/duplications")
    report = json.dumps({"params": asdict(result.params), "filter_rounds": result.filter_rounds, "refinement_rounds": result.refinement_rounds}, default=float)
    spark.createDataFrame([(report,)], "value string").write.mode("overwrite").text(f"{path}/report")
