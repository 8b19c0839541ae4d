"""Queries of the problems tagged llm and, where SQL can state them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandbin.llm.density import density_clusters, describe, peak_clusters
from strandbin.llm.language import LEAST_WORDS, fit, label_documents, label_parts
from strandbin.llm.leaks import PARAPHRASE, RUN, find_leaks
from strandbin.llm.mixture import leaf_sizes, mixture_report, plan, shortfalls, token_counts
from strandbin.llm.neighbours import latest_vectors, measured_recall, nearest
from strandbin.llm.split import ASSEMBLY_GAP, PROSE, split_oversized
from strandbin.llm.topn import top_n_per_group
from strandbin.runtime import table


#: A public tokenizer's file; see the folder's README.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Domains of the boards, the upper level of the mixture; others are "other".
DOMAINS = {"computing": ("assembly_help", "sequencing_runs"), "laboratory": ("bench_talk", "field_sampling"), "writing": ("thesis_corner", "poster_swap")}
#: Power of the languages' sizes by which a board's budget is spread over them in p7_mixture.
SMOOTHING = 0.7
LANGUAGES = ["de", "en", "es", "fr", "nl", "pt", "ru"]
#: Lengths of the vectors of contig_embeddings and features.
CONTIG_WIDTH, KMER_WIDTH = 48, 136
#: How far a density peak of p2_clusters stands from denser rows; cosines of 0.9 are 0.447 apart.
APART = 0.3


def _contig_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return latest_vectors(table(spark, folder, "contig_embeddings"), "contig", "embedding", "loaded_at")


def _fragment_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return latest_vectors(table(spark, folder, "features"), "fragment", "kmer")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = density_clusters(_contig_vectors(spark, folder), CONTIG_WIDTH, 0.9)
    return found.select(F.col("key").alias("contig"), F.col("cluster").alias("first_contig"))


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size of what each density peak draws, and its three contigs of highest density."""
    found = describe(peak_clusters(_contig_vectors(spark, folder), CONTIG_WIDTH, 0.9, APART))
    return found.select(F.col("cluster").alias("first_contig"), F.col("size").alias("contigs"), F.col("typical").alias("typical_contigs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    contigs = nearest(_contig_vectors(spark, folder), CONTIG_WIDTH, 3, True, 0.9)
    fragments = nearest(_fragment_vectors(spark, folder), KMER_WIDTH, 3, False, 0.01)
    both = contigs.select(F.lit("contig_embeddings").alias("tbl"), "key", "other").unionByName(fragments.select(F.lit("features").alias("tbl"), "key", "other"))
    return both.select("tbl", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the true neighbours found, for a sample of rows of each table."""
    contigs = measured_recall(_contig_vectors(spark, folder), CONTIG_WIDTH, 3, True, 0.9).withColumn("tbl", F.lit("contig_embeddings"))
    return contigs.unionByName(measured_recall(_fragment_vectors(spark, folder), KMER_WIDTH, 3, False, 0.01).withColumn("tbl", F.lit("features")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "best_alignments").select("line_no", "contig", "gene_family", "score", "loaded_at")
    latest = lines.groupBy("line_no").agg(F.max_by(F.struct("contig", "gene_family", "score"), F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)).cast(lines.schema["loaded_at"].dataType))).alias("r"))
    known = latest.select("line_no", "r.contig", F.upper(F.trim("r.gene_family")).alias("gene_family"), "r.score").where("gene_family is not null")
    return top_n_per_group(known, ["contig", "gene_family"], "score", "line_no", 3, unique=True).select("contig", "gene_family", "line_no")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "fragments_dict"), "contig", "sequence", 10_000, 5_000, 200, [ASSEMBLY_GAP])


def p5_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of more than 1 200 characters, cut at paragraphs, sentences or words, with 100 characters in common."""
    return split_oversized(table(spark, folder, "documents"), "doc_id", "text", 1_200, 600, 100, PROSE)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return leaks.where(F.col("run") >= RUN).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Verbatim passages and paraphrases that keep the item's answer."""
    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    kind = F.when(F.col("run") >= RUN, "verbatim").when(F.col("answered") & (F.col("in_order") >= PARAPHRASE), "paraphrase")
    return leaks.withColumn("kind", kind).where("kind is not null").select("doc_id", "item_id", "kind", "run", F.round("in_order", 6).alias("in_order"), "answered")


def _with_language(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with ``language``: a listed one by the first letters of the label, else ``other``."""
    given = F.lower(F.substring("lang", 1, 2))
    return table(spark, folder, "documents").withColumn("language", F.when(given.isin(LANGUAGES), given).otherwise("other"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    """The targets with the domain of each board."""
    domain = F.lit("other")
    for name, boards in DOMAINS.items():
        domain = F.when(F.lower(F.trim("source")).isin(*boards), name).otherwise(domain)
    return table(spark, folder, "mix_targets").withColumn("domain", domain)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    root = plan(leaf_sizes(_with_language(spark, folder).select("source", "n_chars", "language"), targets, "source", "n_chars", "language"), targets)
    return spark.createDataFrame([(s,) for s in shortfalls(root)], "source string")


def p7_mixture(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Shares reached when sizes are tokens; boards lie in domains, and small languages of a board are lifted."""
    counted = token_counts(_with_language(spark, folder).select("doc_id", "source", "text", "language"), "text", tokenizer)
    return mixture_report(counted, _targets(spark, folder), "source", "tokens", "doc_id", "language", smoothing=SMOOTHING)


def _languages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    model = fit(table(spark, folder, "lang_samples"), docs)
    return docs, label_parts(docs, model, "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs, parts = _languages(spark, folder)
    counts = label_documents(parts, "doc_id").where(F.col("words") >= LEAST_WORDS)
    by_doc = counts.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"))  # at most one entry per language
    met = docs.select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("given")).join(by_doc, "doc_id")
    wrong = (F.size("langs") >= 2) | F.col("given").isNull() | (F.col("given") != F.col("langs")[0])
    return met.where(wrong).select("doc_id", F.explode("langs").alias("lang"))


def p8_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every post with its language and confidence."""
    return _languages(spark, folder)[1].withColumn("confidence", F.round("confidence", 6))


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks, "p7_found": p7_found, "p7_mixture": p7_mixture, "p8_found": p8_found, "p8_parts": p8_parts, "p2_found": p2_found, "p2_clusters": p2_clusters, "p3_found": p3_found, "p3_recall": p3_recall, "p4_found": p4_found, "p5_found": p5_found, "p5_posts": p5_posts}

_VECTORS = """
        latest AS (SELECT contig, embedding FROM contig_embeddings QUALIFY row_number() OVER (PARTITION BY contig ORDER BY loaded_at DESC) = 1),
        good AS (SELECT contig, embedding::DOUBLE[] AS v FROM latest WHERE len(embedding) = 48 AND len(list_filter(embedding, lambda x: isnan(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        sims AS (SELECT a.contig AS a, b.contig AS b, list_cosine_similarity(a.v, b.v) AS s FROM good a JOIN good b ON a.contig <> b.contig)"""

SQL = {
    "p7_found": """
        WITH t AS (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets),
        s AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(d.n_chars), 0) AS size
              FROM t LEFT JOIN documents d ON lower(trim(d.source)) = t.source GROUP BY ALL)
        SELECT source FROM s WHERE max_repeats * size < target_share * (SELECT sum(size) FROM s)""",
    "p2_found": f"""
        WITH RECURSIVE {_VECTORS},
        links AS (SELECT a, b FROM sims WHERE s >= 0.9),
        reach(contig, first_contig) USING KEY (contig) AS (
            SELECT a, least(a, min(b)) FROM links GROUP BY a
            UNION
            SELECT l.a, min(r.first_contig) FROM links l JOIN reach r ON r.contig = l.b JOIN recurring.reach own ON own.contig = l.a
            WHERE r.first_contig < own.first_contig GROUP BY l.a)
        SELECT contig, first_contig FROM reach""",
    "p3_found": f"""
        WITH {_VECTORS},
        frags AS (SELECT fragment, any_value(kmer) AS v FROM features WHERE kmer IS NOT NULL GROUP BY fragment),
        gaps AS (SELECT a.fragment AS a, b.fragment AS b, round(list_distance(a.v, b.v), 6) AS d FROM frags a JOIN frags b ON a.fragment <> b.fragment),
        top AS (SELECT 'contig_embeddings' AS tbl, a, b FROM (SELECT a, b, round(s, 6) AS s FROM sims) WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 3
                UNION ALL SELECT 'features', a, b FROM gaps WHERE d <= 0.01 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 3)
        SELECT DISTINCT tbl, least(a, b) AS key_a, greatest(a, b) AS key_b FROM top""",
    "p4_found": """
        WITH latest AS (SELECT line_no, contig, upper(trim(gene_family)) AS gene_family, score FROM best_alignments
                        QUALIFY row_number() OVER (PARTITION BY line_no ORDER BY loaded_at DESC) = 1)
        SELECT contig, gene_family, line_no FROM latest WHERE score IS NOT NULL AND NOT isnan(score) AND gene_family IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY contig, gene_family ORDER BY score DESC, line_no) <= 3""",
    "p5_found": """
        WITH RECURSIVE seqs AS (SELECT contig, max(sequence) AS s, max(length(sequence)) AS n FROM fragments_dict GROUP BY contig HAVING max(length(sequence)) > 10000),
        gaps AS (SELECT contig, p FROM (SELECT contig, s, unnest(generate_series(10, n)) AS p FROM seqs)
                 WHERE regexp_full_match(substring(s, p - 9, 10), '[^ACGTacgt]{10}') AND NOT regexp_matches(substring(s, p + 1, 1), '[^ACGTacgt]')),
        pieces AS (
            SELECT contig, n, 0 AS piece_no, 0 AS start_pos,
                   coalesce((SELECT max(p) FROM gaps g WHERE g.contig = q.contig AND p BETWEEN 5000 AND 10000), 10000)::INT AS end_pos FROM seqs q
            UNION ALL
            SELECT contig, n, piece_no + 1, end_pos - 200,
                   (CASE WHEN n - (end_pos - 200) <= 10000 THEN n
                         ELSE coalesce((SELECT max(p) FROM gaps g WHERE g.contig = r.contig AND p BETWEEN r.end_pos - 200 + 5000 AND r.end_pos - 200 + 10000), end_pos - 200 + 10000) END)::INT
            FROM pieces r WHERE end_pos < n)
        SELECT contig, piece_no::INT AS piece_no, start_pos::INT AS start_pos, end_pos FROM pieces""",
}
