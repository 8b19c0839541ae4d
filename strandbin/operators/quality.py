"""Bins: sizes, marker genes found twice, what to refine, final assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbin.functions.rules import ratio, refinement_k

NOISE = "noise"


def scored_lines(lines: DataFrame, least_coverage: float, least_identity: float) -> DataFrame:
    """Alignment lines with ``coverage`` of the target, ``identity`` and their product, those below either limit left out."""
    coverage = ratio(F.col("target_end") - F.col("target_start"), F.col("target_length"))
    identity = ratio(F.col("matches"), F.col("alignment_length"))
    return lines.withColumns({"coverage": coverage, "identity": identity}).where((F.col("coverage") >= least_coverage) & (F.col("identity") >= least_identity)).withColumn("product", F.col("coverage") * F.col("identity"))


def best_lines(scored: DataFrame) -> DataFrame:
    """Per contig and gene family the line of the largest product; of equals the first line.

    A plain aggregate, so a contig with a third of all lines is combined before the shuffle.
    """
    best = F.max(F.struct("product", (-F.col("line_no")).alias("back"))).alias("b")
    return scored.groupBy("contig", "gene_family").agg(best).select("contig", "gene_family", F.col("b.product").alias("product"), (-F.col("b.back")).alias("line_no"))


def bin_sizes(bins: DataFrame, lengths: DataFrame, least: int = 0) -> DataFrame:
    """``cluster, contigs, bases`` of bins (noise left out) with at least ``least`` bases; a contig counts once."""
    members = bins.where(F.col("cluster") != NOISE).select("cluster", "contig").distinct()
    return members.join(lengths, "contig").groupBy("cluster").agg(F.count(F.lit(1)).alias("contigs"), F.sum("length").alias("bases")).where(F.col("bases") >= least)


def family_counts(bins: DataFrame, best: DataFrame) -> DataFrame:
    """``cluster, gene_family, contigs``: contigs of a bin that carry the family."""
    carriers = best.select("contig", "gene_family").where("gene_family is not null").distinct()
    return bins.where(F.col("cluster") != NOISE).select("contig", "cluster").join(carriers, "contig").groupBy("cluster", "gene_family").agg(F.count(F.lit(1)).alias("contigs"))


def duplicated_genes(counts: DataFrame) -> DataFrame:
    """``cluster, has_duplications, duplicated_genes map, duplicated_count, most_copies, total_genes_found``."""
    twice = F.col("contigs") > 1
    pairs = F.sort_array(F.collect_list(F.when(twice, F.struct("gene_family", "contigs"))))
    return counts.groupBy("cluster").agg(
        F.max(twice).alias("has_duplications"),
        F.map_from_entries(pairs).alias("duplicated_genes"),
        F.count_if(twice).alias("duplicated_count"),
        F.max("contigs").alias("most_copies"),
        F.count(F.lit(1)).alias("total_genes_found"),
    )


def annotated(bins: DataFrame, duplications: DataFrame) -> DataFrame:
    """The assignment with its bin's quality columns; bins without genes get False, 0 and 0."""
    cols = duplications.select("cluster", F.col("has_duplications").alias("has_duplicated_core_genes"), F.col("duplicated_count").alias("duplicated_core_genes_count"), F.col("total_genes_found").alias("total_core_genes_found"))
    joined = bins.select("contig", "cluster").join(cols, "cluster", "left")
    return joined.na.fill(False, ["has_duplicated_core_genes"]).na.fill(0, ["duplicated_core_genes_count", "total_core_genes_found"])


def refinement_targets(quality: DataFrame, duplications: DataFrame) -> DataFrame:
    """``cluster, contigs, k, status``: flagged bins, the sub-bins to look for, and ``skipped`` if there are too few contigs."""
    flagged = quality.where("has_duplicated_core_genes").where(F.col("cluster") != NOISE).groupBy("cluster").agg(F.countDistinct("contig").alias("contigs"))
    joined = flagged.join(duplications.select("cluster", "duplicated_count"), "cluster", "left")
    k = refinement_k(F.col("duplicated_count"), F.col("contigs")).cast("int")
    return joined.select("cluster", "contigs", k.alias("k"), F.when(F.col("contigs") < 2, "skipped").otherwise("eligible").alias("status"))


def merge_refined(bins: DataFrame, refined: DataFrame) -> DataFrame:
    """``contig, cluster, original_bin``: refined bins replace their original; others stay as they are.

    ``refined`` has ``contig, cluster, original_bin``. Only bins that were split into more than one are replaced.
    """
    split = refined.where(F.col("cluster") != NOISE).groupBy("original_bin").agg(F.countDistinct("cluster").alias("n")).where("n > 1").select("original_bin")
    kept = bins.select("contig", "cluster").join(split.withColumnRenamed("original_bin", "cluster"), "cluster", "left_anti").withColumn("original_bin", F.lit(None).cast("string"))
    new = refined.join(split, "original_bin", "left_semi").select("contig", "cluster", "original_bin")
    return kept.select("contig", "cluster", "original_bin").unionByName(new)
