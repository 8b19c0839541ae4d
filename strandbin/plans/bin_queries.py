"""Queries over class scores, assignments, marker genes and refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbin.functions import rules
from strandbin.operators import classify as cl
from strandbin.operators import quality as q
from strandbin.operators.cluster import split_groups
from strandbin.operators.fragments import positive_pairs as pairs_of
from strandbin.operators.skew import join_by_key, number_rows
from strandbin.params import Params
from strandbin.plans import views as v
from strandbin.plans.views import with_views
from strandbin.runtime import stage, table

LEAST_COVERAGE, LEAST_IDENTITY, LEAST_BIN = 0.5, 0.5, 10_000
#: Epochs, peak learning rate and pairs of a training batch.
EPOCHS, PEAK, BATCH = 400, 0.0128, 2048


def gene_family(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "best_alignments").select("query").distinct().withColumn("family", rules.gene_family(F.col("query")))


def safe_ratio(spark: SparkSession, folder: str) -> DataFrame:
    cols = v.lines(spark, folder, "target_start", "target_end", "target_length", "matches", "alignment_length")
    return cols.select("line_no", F.round(rules.ratio(F.col("target_end") - F.col("target_start"), F.col("target_length")), 6).alias("coverage"), F.round(rules.ratio(F.col("matches"), F.col("alignment_length")), 6).alias("identity"))


def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of each fragment with the next of its contig and half."""
    f = v.fragments(spark, folder).where("ordinal is not null and length is not null and start_pos is not null")
    a, b = f.alias("a"), f.alias("b")
    met = a.join(b, (F.col("a.contig") == F.col("b.contig")) & F.col("a.half").eqNullSafe(F.col("b.half")) & (F.col("a.ordinal") + 1 == F.col("b.ordinal")))
    return met.select(F.col("a.fragment").alias("fragment"), F.col("b.fragment").alias("next_fragment"), F.round(rules.overlap_share(F.col("a.start_pos"), F.col("a.length"), F.col("b.start_pos"), F.col("b.length")), 6).alias("share"))


def fragment_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments in the halves of each contig that has both."""
    n = v.fragments(spark, folder).where("half in ('h1', 'h2')").groupBy("contig").agg(F.count_if(F.col("half") == "h1").alias("h1"), F.count_if(F.col("half") == "h2").alias("h2"))
    return n.where("h1 > 0 and h2 > 0").select("contig", "h1", "h2", F.round(F.least("h1", "h2") / F.greatest("h1", "h2"), 6).alias("share"))


def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The learning rate of each epoch, and the batches of positive pairs trained on until its end; a short last one is left out."""
    n = _feature_members(spark, folder).distinct().groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    batches = n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs")).select(F.expr(f"pairs div {BATCH}").alias("each"))
    epochs = batches.select("each", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"))
    return epochs.select("epoch", F.round(rules.learning_rate_at(F.col("epoch"), EPOCHS, PEAK), 9).alias("rate"), (F.col("each") * (F.col("epoch") + 1)).alias("batches"))


def frag_original(spark: SparkSession, folder: str) -> DataFrame:
    return v.fragments(spark, folder).where("kind = 'original'").select("contig", "fragment").distinct()


def _feature_members(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "features").select("fragment").distinct().join(v.fragments(spark, folder).select("fragment", "contig").distinct(), "fragment")


def positive_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_of(_feature_members(spark, folder), "contig", "fragment", 5_000_000)


def pairs_capped(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth as many pairs as fragments, drawn over the contigs in proportion to their pairs."""
    members = v.fragments(spark, folder)
    return pairs_of(members, "contig", "fragment", max(1, members.select("fragment").distinct().count() // 20))


def pairs_of_all(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of all fragments under the cap of the whole run."""
    return pairs_of(v.fragments(spark, folder), "contig", "fragment", Params().max_positive_pairs)


def predicted_class(spark: SparkSession, folder: str) -> DataFrame:
    return v.scores(spark, folder).select("contig", cl.predicted_class().alias("predicted_class"))


def bacterial_filter(spark: SparkSession, folder: str) -> DataFrame:
    return cl.bacterial_filter(v.scores(spark, folder)).select("contig")


def bacterial_filter_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """With a limit that drops every contig, all stay."""
    return cl.bacterial_filter(v.scores(spark, folder), drop_above=-1.0).select("contig")


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all contigs by classifiers trained on those whose alignment lines name a class."""
    number = F.array_position(F.array(*map(F.lit, cl.CLASSES)), cl.predicted_class()) - 1
    labels = v.scores(spark, folder).select("contig", number.alias("label"))
    rows = stage(v.contigs(spark, folder).join(labels, "contig", "left"), "class-contigs")  # a null label is none
    models = cl.train_classifiers(rows, "contig", "seq", "label")
    return cl.class_scores(rows, "contig", "seq", models).select("contig", *[F.round(c, 6).alias(c) for c in cl.CLASSES])


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    kind = cl.predicted_class()
    return v.scores(spark, folder).withColumn("kind", kind).groupBy("kind").agg(F.count(F.lit(1)).alias("contigs"), F.count_if(F.col("eukaryotic") > cl.HIGH).alias("surely_eukaryotic"), F.count_if(cl.is_bacterial()).alias("dropped"), F.round(F.avg("eukaryotic"), 6).alias("mean_eukaryotic"))


def _best(spark: SparkSession, folder: str) -> DataFrame:
    known = v.lines(spark, folder, "contig", "gene_family", "target_start", "target_end", "target_length", "matches", "alignment_length").where("gene_family is not null").withColumn("gene_family", F.upper(F.trim("gene_family")))
    return q.best_lines(q.scored_lines(known, LEAST_COVERAGE, LEAST_IDENTITY))


def paf_best(spark: SparkSession, folder: str) -> DataFrame:
    return _best(spark, folder).withColumn("product", F.round("product", 6))


def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Bin numbers of the assignment, -1 for noise, and the label made from them."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(cluster, '_([0-9]+)$', 1) as int)"), F.lit(-1))
    return v.bins(spark, folder).select("contig", number.alias("number"), F.when(number < 0, q.NOISE).otherwise(F.concat(F.lit("bin_"), number.cast("string"))).alias("label"))


def cluster_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The set of contigs of every group, noise too, one row each with the size of the group; no set lies in one row."""
    members = v.bins(spark, folder).select("cluster", "contig").distinct()
    return join_by_key(members, members.groupBy("cluster").agg(F.count(F.lit(1)).alias("contigs")), "cluster")


def cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    """Contigs of every group, noise too, one row each with its place in the group; sizes are in :func:`cluster_counts`."""
    return number_rows(v.bins(spark, folder).select("cluster", "contig"), "cluster", ["contig"])


def cluster_counts(spark: SparkSession, folder: str) -> DataFrame:
    return v.bins(spark, folder).groupBy("cluster").agg(F.count(F.lit(1)).alias("contigs"))


def contig_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Contigs of the assignment that have a sequence, with their stored header."""
    headers = table(spark, folder, "fragments_dict").where("sequence is not null").groupBy("contig").agg(F.min(F.concat_ws(" ", "contig", "description")).alias("header"))
    return v.bins(spark, folder).select("contig", "cluster").join(headers, "contig")


def bin_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return q.bin_sizes(v.bins(spark, folder), v.lengths(spark, folder), LEAST_BIN)


def gene_family_counts(spark: SparkSession, folder: str) -> DataFrame:
    return q.family_counts(v.bins(spark, folder), _best(spark, folder))


def _duplications(spark: SparkSession, folder: str) -> DataFrame:
    return q.duplicated_genes(gene_family_counts(spark, folder))


def duplicated_genes(spark: SparkSession, folder: str) -> DataFrame:
    found = _duplications(spark, folder)
    text = F.array_join(F.transform(F.sort_array(F.map_entries("duplicated_genes")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return found.withColumn("duplicated_genes", text)


def bins_annotated(spark: SparkSession, folder: str) -> DataFrame:
    return q.annotated(v.bins(spark, folder), _duplications(spark, folder))


def contaminated_bins(spark: SparkSession, folder: str) -> DataFrame:
    return bins_annotated(spark, folder).where("has_duplicated_core_genes").where(F.col("cluster") != q.NOISE).select("cluster").distinct()


def refine_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    return q.refinement_targets(bins_annotated(spark, folder), _duplications(spark, folder))


def refine_k(spark: SparkSession, folder: str) -> DataFrame:
    """Sub-bins to look for in every bin with marker genes, flagged or not."""
    sizes = v.bins(spark, folder).groupBy("cluster").agg(F.count(F.lit(1)).alias("contigs"))
    return sizes.join(_duplications(spark, folder), "cluster").select("cluster", rules.refinement_k(F.col("duplicated_count"), F.col("contigs")).cast("int").alias("k"))


def later_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of an earlier run's later rounds by the bin they came from."""
    later = v.bins(spark, folder).where("original_bin is not null and cluster <> 'noise'").select("cluster", F.lower(F.trim("original_bin")).alias("original_bin"))
    return later.groupBy("original_bin").agg(F.countDistinct("cluster").alias("sub_bins"), F.count(F.lit(1)).alias("contigs"))


def _refined(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The assignment, and the refinement of its flagged bins by k-means of their contigs' vectors."""
    bins = v.bins(spark, folder).select("contig", "cluster")
    dup = stage(_duplications(spark, folder), "duplications")
    k = q.refinement_targets(q.annotated(bins, dup), dup).where("status = 'eligible'").select(F.col("cluster").alias("grp"), "k")
    rows = bins.join(v.vectors(spark, folder), "contig").select(F.col("cluster").alias("grp"), F.col("contig").alias("key"), "v")
    found = split_groups(rows, stage(k, "targets"))
    return bins, found.select(F.col("key").alias("contig"), F.concat("grp", F.lit("_refined_bin_"), F.col("label").cast("string")).alias("cluster"), F.col("grp").alias("original_bin"))


def refine_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """Sub-bins of the flagged bins that have enough contigs."""
    return _refined(spark, folder)[1]


def refine_subbins(spark: SparkSession, folder: str) -> DataFrame:
    """Per refined bin: its sub-bins, how many contigs they have, and how many of them still hold a gene twice."""
    refined = stage(_refined(spark, folder)[1], "refined")
    still = q.duplicated_genes(q.family_counts(refined.select("contig", "cluster"), _best(spark, folder))).where("has_duplications").select("cluster", F.lit(1).alias("still"))
    return refined.join(still, "cluster", "left").groupBy("original_bin").agg(F.countDistinct("cluster").alias("sub_bins"), F.count(F.lit(1)).alias("contigs"), F.countDistinct(F.when(F.col("still") == 1, F.col("cluster"))).alias("still_duplicated"))


def refine_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The assignment after one round: bins that fell into several are replaced, all others stay."""
    bins, refined = _refined(spark, folder)
    return q.merge_refined(bins, stage(refined, "refined"))


def bins_final(spark: SparkSession, folder: str) -> DataFrame:
    """Contigs of bins that are large enough; noise is left out."""
    return v.bins(spark, folder).where(F.col("cluster") != q.NOISE).select("contig", "cluster").join(bin_sizes(spark, folder).select("cluster"), "cluster", "left_semi")


def recluster_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Per round: bins found, and whether clustering would be tried again with a larger least size (exactly one bin)."""
    rows = table(spark, folder, "clusters_df").select("round_no", F.coalesce(F.lower(F.trim("cluster")), F.lit(q.NOISE)).alias("cluster"))
    found = rows.groupBy("round_no").agg(F.countDistinct(F.when(F.col("cluster") != q.NOISE, F.col("cluster"))).alias("bins_found"))
    return found.withColumn("try_again", F.col("bins_found") == 1)


def pipeline_summary(spark: SparkSession, folder: str) -> DataFrame:
    a = bins_annotated(spark, folder)
    return a.agg(
        F.count(F.lit(1)).alias("contigs"),
        F.count_if(F.col("cluster") == q.NOISE).alias("noise_contigs"),
        F.countDistinct(F.when(F.col("cluster") != q.NOISE, F.col("cluster"))).alias("bins"),
        F.countDistinct(F.when(F.col("has_duplicated_core_genes"), F.col("cluster"))).alias("bins_with_duplicates"),
    )


QUERIES = {f.__name__: f for f in (gene_family, safe_ratio, interval_overlap, fragment_ratio, lr_schedule, frag_original, positive_pairs, pairs_capped, pairs_of_all, predicted_class, bacterial_filter, bacterial_filter_fallback, class_scores, score_summary, paf_best, cluster_labels, cluster_sets, cluster_members, cluster_counts, contig_lookup, bin_sizes, gene_family_counts, duplicated_genes, bins_annotated, contaminated_bins, refine_eligibility, refine_k, refine_kmeans, refine_subbins, refine_merge, later_rounds, bins_final, recluster_rule, pipeline_summary)}

_BEST = f"""scored AS (SELECT line_no, contig, upper(trim(gene_family)) AS gene_family, (target_end - target_start)::DOUBLE / target_length AS cov, matches::DOUBLE / alignment_length AS ident
            FROM lines WHERE gene_family IS NOT NULL AND target_length > 0 AND alignment_length > 0),
        best AS (SELECT contig, gene_family, cov * ident AS product, line_no FROM scored WHERE cov >= {LEAST_COVERAGE} AND ident >= {LEAST_IDENTITY}
            QUALIFY row_number() OVER (PARTITION BY contig, gene_family ORDER BY cov * ident DESC, line_no) = 1)"""
_DUP = f"""{_BEST}, counts AS (SELECT cluster, gene_family, count(*) AS contigs FROM bins JOIN best USING (contig) WHERE cluster <> 'noise' GROUP BY ALL),
        dup AS (SELECT cluster, bool_or(contigs > 1) AS has_duplications, count(*) FILTER (contigs > 1) AS duplicated_count, max(contigs) AS most_copies, count(*) AS total_genes_found,
                coalesce(string_agg(gene_family || ':' || contigs, ',' ORDER BY gene_family) FILTER (contigs > 1), '') AS duplicated_genes FROM counts GROUP BY cluster),
        annotated AS (SELECT contig, cluster, coalesce(has_duplications, false) AS has_duplicated_core_genes, coalesce(duplicated_count, 0) AS duplicated_core_genes_count,
                coalesce(total_genes_found, 0) AS total_core_genes_found FROM bins LEFT JOIN dup USING (cluster))"""
# The number of duplicated genes, at least 2; one less than the contigs, still at least 2, where there are fewer of them.
_K = "(CASE WHEN contigs < greatest(2, duplicated_count) THEN greatest(2, contigs - 1) ELSE greatest(2, duplicated_count) END)::INT"
_KIND = "CASE WHEN viral >= greatest(plasmid, prokaryotic, eukaryotic) THEN 'viral' WHEN plasmid >= greatest(prokaryotic, eukaryotic) THEN 'plasmid' WHEN prokaryotic >= eukaryotic THEN 'prokaryotic' ELSE 'eukaryotic' END"
_SIZES = f"sizes AS (SELECT cluster, count(*) AS contigs, sum(length)::BIGINT AS bases FROM bins JOIN lengths USING (contig) WHERE cluster <> 'noise' GROUP BY cluster HAVING sum(length) >= {LEAST_BIN})"



def _pairs(cap: str) -> str:
    """Pairs of fragments of one contig, at most ``cap``, from the rules: proportional quotas, draws in order until there are enough."""
    return with_views("frags", f""", m AS (SELECT contig, fragment, row_number() OVER (PARTITION BY contig ORDER BY fragment) - 1 AS i FROM (SELECT DISTINCT contig, fragment FROM frags)),
        s AS (SELECT contig, count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM m GROUP BY contig HAVING count(*) > 1),
        c AS (SELECT least({cap}, (SELECT sum(pairs) FROM s))::HUGEINT AS cap, (SELECT sum(pairs) FROM s)::HUGEINT AS total),
        f AS (SELECT contig, pairs, pairs * cap // total AS low, pairs * cap % total AS rest, cap FROM s, c),
        t AS (SELECT contig, pairs, (low + (row_number() OVER (ORDER BY rest DESC, contig) <= cap - sum(low) OVER ())::INT)::BIGINT AS quota FROM f),
        d AS (SELECT contig, pairs, quota, least(quota, pairs - quota) AS drawn FROM t WHERE quota > 0),
        draws AS (SELECT contig, drawn, ('0x' || substr(md5(contig || '|' || t || '|0'), 1, 15))::BIGINT % pairs AS r, t FROM (SELECT contig, pairs, drawn, unnest(range(2 * drawn + 64)) AS t FROM d WHERE drawn > 0)),
        picked AS (SELECT contig, r FROM (SELECT contig, drawn, r, min(t) AS t FROM draws GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY contig ORDER BY t) <= drawn),
        r AS (SELECT contig, r FROM picked SEMI JOIN (SELECT contig FROM d WHERE quota * 2 <= pairs) USING (contig)
              UNION ALL SELECT contig, r FROM (SELECT contig, unnest(range(pairs)) AS r FROM d WHERE quota * 2 > pairs) ANTI JOIN picked USING (contig, r)),
        ij AS (SELECT contig, r, j + (j * (j + 1) // 2 <= r)::INT - (j * (j - 1) // 2 > r)::INT AS j FROM (SELECT contig, r, floor((1 + sqrt(1.0 + 8.0 * r)) / 2)::BIGINT AS j FROM r))
        SELECT ij.contig, a.fragment AS first, b.fragment AS second FROM ij JOIN m b ON b.contig = ij.contig AND b.i = j JOIN m a ON a.contig = ij.contig AND a.i = r - j * (j - 1) // 2""")


SQL = {
    "gene_family": r"SELECT DISTINCT query, string_split(string_split(query, ' ')[1], ':')[-1] AS family FROM best_alignments",
    "safe_ratio": with_views("lines", "SELECT line_no, round(coalesce(CASE WHEN target_length > 0 THEN (target_end - target_start)::DOUBLE / target_length END, 0), 6) AS coverage, round(coalesce(CASE WHEN alignment_length > 0 THEN matches::DOUBLE / alignment_length END, 0), 6) AS identity FROM lines"),
    "interval_overlap": with_views("frags", """, f AS (SELECT * FROM frags WHERE ordinal IS NOT NULL AND length IS NOT NULL AND start_pos IS NOT NULL)
        SELECT a.fragment, b.fragment AS next_fragment, round(CASE WHEN greatest(a.length, b.length) > 0 THEN greatest(0, least(a.start_pos + a.length, b.start_pos + b.length) - greatest(a.start_pos, b.start_pos))::DOUBLE / greatest(a.length, b.length) ELSE 0 END, 6) AS share
        FROM f a JOIN f b ON a.contig = b.contig AND a.half IS NOT DISTINCT FROM b.half AND a.ordinal + 1 = b.ordinal"""),
    "fragment_ratio": with_views("frags", "SELECT contig, h1, h2, round(least(h1, h2)::DOUBLE / greatest(h1, h2), 6) AS share FROM (SELECT contig, count(*) FILTER (half = 'h1') AS h1, count(*) FILTER (half = 'h2') AS h2 FROM frags GROUP BY contig) WHERE h1 > 0 AND h2 > 0"),
    "lr_schedule": with_views("frags", """, m AS (SELECT DISTINCT fragment, contig FROM frags SEMI JOIN features USING (fragment)), p AS (SELECT (SELECT count(*) FROM m a JOIN m b ON a.contig = b.contig AND a.fragment < b.fragment) // 2048 AS each),
        e AS (SELECT unnest(range(400))::INT AS epoch)
        SELECT epoch, round(0.0128::DOUBLE * CASE WHEN epoch < 10 THEN 0.1 + 0.9 * epoch / 10::DOUBLE ELSE 0.01 + 0.99 * 0.5 * (1 + cos(pi() * (epoch - 10) / 390)) END, 9) AS rate, (epoch + 1) * each AS batches FROM e, p"""),
    "frag_original": with_views("frags", "SELECT DISTINCT contig, fragment FROM frags WHERE kind = 'original'"),
    "positive_pairs": with_views("frags", ", m AS (SELECT DISTINCT fragment, contig FROM frags SEMI JOIN features USING (fragment)) SELECT a.contig, a.fragment AS first, b.fragment AS second FROM m a JOIN m b ON a.contig = b.contig AND a.fragment < b.fragment"),
    "pairs_capped": _pairs("greatest(1, (SELECT count(DISTINCT fragment) FROM m) // 20)"),
    "pairs_of_all": _pairs("5000000"),
    "predicted_class": with_views("lines scores", f"SELECT contig, {_KIND} AS predicted_class FROM scores"),
    "bacterial_filter": with_views("lines scores", "SELECT contig FROM scores WHERE NOT (prokaryotic > 0.5 OR plasmid > 0.5)"),
    "bacterial_filter_fallback": with_views("lines scores", "SELECT contig FROM scores"),
    "score_summary": with_views("lines scores", f"SELECT {_KIND} AS kind, count(*) AS contigs, count(*) FILTER (eukaryotic > 0.95) AS surely_eukaryotic, count(*) FILTER (prokaryotic > 0.5 OR plasmid > 0.5) AS dropped, round(avg(eukaryotic), 6) AS mean_eukaryotic FROM scores GROUP BY 1"),
    "paf_best": with_views("lines", f", {_BEST} SELECT contig, gene_family, round(product, 6) AS product, line_no FROM best"),
    "cluster_labels": with_views("bins", "SELECT contig, n AS number, CASE WHEN n < 0 THEN 'noise' ELSE 'bin_' || n END AS label FROM (SELECT contig, coalesce(try_cast(regexp_extract(cluster, '_([0-9]+)$', 1) AS INT), -1) AS n FROM bins)"),
    "cluster_sets": with_views("bins", "SELECT cluster, contig, count(*) OVER (PARTITION BY cluster) AS contigs FROM (SELECT DISTINCT cluster, contig FROM bins)"),
    "cluster_members": with_views("bins", "SELECT cluster, contig, row_number() OVER (PARTITION BY cluster ORDER BY contig NULLS FIRST) - 1 AS row_no FROM bins"),
    "cluster_counts": with_views("bins", "SELECT cluster, count(*) AS contigs FROM bins GROUP BY cluster"),
    "contig_lookup": with_views("bins", "SELECT contig, cluster, header FROM bins JOIN (SELECT contig, min(concat_ws(' ', contig, description)) AS header FROM fragments_dict WHERE sequence IS NOT NULL GROUP BY contig) USING (contig)"),
    "bin_sizes": with_views("bins lengths", f", {_SIZES} SELECT cluster, contigs, bases FROM sizes"),
    "gene_family_counts": with_views("bins lines", f", {_DUP} SELECT cluster, gene_family, contigs FROM counts"),
    "duplicated_genes": with_views("bins lines", f", {_DUP} SELECT cluster, has_duplications, duplicated_genes, duplicated_count, most_copies, total_genes_found FROM dup"),
    "bins_annotated": with_views("bins lines", f", {_DUP} SELECT * FROM annotated"),
    "contaminated_bins": with_views("bins lines", f", {_DUP} SELECT DISTINCT cluster FROM annotated WHERE has_duplicated_core_genes AND cluster <> 'noise'"),
    "refine_eligibility": with_views("bins lines", f", {_DUP} SELECT cluster, contigs, {_K} AS k, CASE WHEN contigs < 2 THEN 'skipped' ELSE 'eligible' END AS status FROM (SELECT cluster, count(DISTINCT contig) AS contigs FROM annotated WHERE has_duplicated_core_genes AND cluster <> 'noise' GROUP BY cluster) JOIN dup USING (cluster)"),
    "refine_k": with_views("bins lines", f", {_DUP} SELECT cluster, {_K} AS k FROM (SELECT cluster, count(*) AS contigs FROM bins GROUP BY cluster) JOIN dup USING (cluster)"),
    "later_rounds": with_views("bins", "SELECT lower(trim(original_bin)) AS original_bin, count(DISTINCT cluster) AS sub_bins, count(*) AS contigs FROM bins WHERE original_bin IS NOT NULL AND cluster <> 'noise' GROUP BY ALL"),
    "bins_final": with_views("bins lengths", f", {_SIZES} SELECT contig, cluster FROM bins WHERE cluster IN (SELECT cluster FROM sizes)"),
    "recluster_rule": "SELECT round_no, count(DISTINCT c) FILTER (c <> 'noise') AS bins_found, count(DISTINCT c) FILTER (c <> 'noise') = 1 AS try_again FROM (SELECT round_no, coalesce(lower(trim(cluster)), 'noise') AS c FROM clusters_df) GROUP BY round_no",
    "pipeline_summary": with_views("bins lines", f", {_DUP} SELECT count(*) AS contigs, count(*) FILTER (cluster = 'noise') AS noise_contigs, count(DISTINCT cluster) FILTER (cluster <> 'noise') AS bins, count(DISTINCT cluster) FILTER (has_duplicated_core_genes) AS bins_with_duplicates FROM annotated"),
}
