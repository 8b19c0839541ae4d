"""Inputs that several queries share, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbin.runtime import table

SAMPLES = ("s1", "s2", "s3")


def raw_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a sequence as stored, upper case: ``contig, seq``. Rows that were sent twice are still there."""
    return table(spark, folder, "fragments_dict").where("sequence is not null").select("contig", F.upper("sequence").alias("seq"))


def contigs(spark: SparkSession, folder: str) -> DataFrame:
    """``contig, seq``, each contig once."""
    return raw_contigs(spark, folder).groupBy("contig").agg(F.max("seq").alias("seq"))


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    """``contig, length`` of contigs and controls by their sequences, each once; the sequences are not shuffled."""
    both = table(spark, folder, "fragments_dict").unionByName(table(spark, folder, "control_contigs"))
    return both.where("sequence is not null").groupBy("contig").agg(F.max(F.length("sequence")).alias("length"))


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """``fragment, contig, kind, half, ordinal, start_pos, length``, rows that were sent twice once."""
    return table(spark, folder, "fragments").where("contig is not null").select("fragment", "contig", "kind", "half", "ordinal", "start_pos", "length").distinct()


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The latest row of each alignment line: ``line_no`` and the columns named, by default all."""
    rows = table(spark, folder, "best_alignments")
    cols = columns or [c for c in rows.columns if c not in ("line_no", "loaded_at")]
    return rows.groupBy("line_no").agg(F.max_by(F.struct(*cols), "loaded_at").alias("r")).select("line_no", "r.*")


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment lines as reads of three samples: ``sample, contig, start, end``."""
    return lines(spark, folder, "contig", "target_start", "target_end").select(F.concat(F.lit("s"), (F.col("line_no") % 3 + 1).cast("string")).alias("sample"), "contig", F.col("target_start").alias("start"), F.col("target_end").alias("end"))


def clean_name(name: F.Column) -> F.Column:
    """A contig's name without what was added to it in the assignment table."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\s.*$", ""), r"\.original$", "")


def bins(spark: SparkSession, folder: str) -> DataFrame:
    """The last round's bin of every contig: ``contig, cluster, round_no, original_bin``; null labels are noise."""
    rows = table(spark, folder, "clusters_df").select(clean_name(F.col("contig")).alias("contig"), F.coalesce(F.lower(F.trim("cluster")), F.lit("noise")).alias("cluster"), "round_no", "original_bin", "loaded_at")
    return rows.groupBy("contig").agg(F.max_by(F.struct("cluster", "round_no", "original_bin"), F.struct("round_no", "loaded_at", "cluster")).alias("r")).select("contig", "r.*")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The usable latest vector of every contig: ``contig, v array<double>``."""
    rows = table(spark, folder, "contig_embeddings").select("contig", "loaded_at", F.col("embedding").cast("array<double>").alias("v"))
    latest = rows.groupBy("contig").agg(F.max(F.struct("loaded_at", "v")).alias("r")).select("contig", F.col("r.v").alias("v"))
    return latest.where((F.size("v") == 48) & F.forall("v", lambda x: ~F.isnan(x)) & F.exists("v", lambda x: x != 0))


#: The class that a gene family's last letter stands for in the alignment lines.
FAMILY_CLASSES = {"V": "viral", "L": "plasmid", "A": "prokaryotic", "E": "eukaryotic"}


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Class scores of the contigs that have scored lines: each class's share of the contig's alignment scores."""
    rows = lines(spark, folder, "contig", "gene_family", "score").where("score > 0 and not isnan(score)")
    letter = F.right(F.upper(F.trim("gene_family")), F.lit(1))
    known = rows.select("contig", letter.alias("letter"), "score").where(F.col("letter").isin(*FAMILY_CLASSES))
    sums = known.groupBy("contig").agg(F.sum("score").alias("total"), *[F.sum(F.when(F.col("letter") == c, F.col("score")).otherwise(0.0)).alias(name) for c, name in FAMILY_CLASSES.items()])
    # Sums differ in their last digits by the order of addition.
    return sums.select("contig", *[F.round(F.col(name) / F.col("total"), 9).alias(name) for name in FAMILY_CLASSES.values()])


#: Common table expressions by name; see :func:`with_views`.
SQL_VIEWS = {
    "contigs": "SELECT contig, upper(max(sequence)) AS seq FROM fragments_dict WHERE sequence IS NOT NULL GROUP BY contig",
    "lengths": "SELECT contig, max(length(sequence))::INT AS length FROM (SELECT contig, sequence FROM fragments_dict UNION ALL SELECT contig, sequence FROM control_contigs) WHERE sequence IS NOT NULL GROUP BY contig",
    "frags": "SELECT DISTINCT fragment, contig, kind, half, ordinal, start_pos, length FROM fragments WHERE contig IS NOT NULL",
    "lines": "SELECT * EXCLUDE (loaded_at) FROM best_alignments QUALIFY row_number() OVER (PARTITION BY line_no ORDER BY loaded_at DESC) = 1",
    "reads": "SELECT 's' || (line_no % 3 + 1)::VARCHAR AS sample, contig, target_start AS start, target_end AS stop FROM lines",
    "bins": r"""SELECT contig, cluster, round_no, original_bin FROM (
            SELECT regexp_replace(regexp_replace(trim(contig), '\s.*$', ''), '\.original$', '') AS contig, coalesce(lower(trim(cluster)), 'noise') AS cluster, round_no, original_bin, loaded_at FROM clusters_df)
            QUALIFY row_number() OVER (PARTITION BY contig ORDER BY round_no DESC, loaded_at DESC, cluster DESC) = 1""",
    "vecs": """SELECT contig, embedding::DOUBLE[] AS v FROM (SELECT contig, embedding FROM contig_embeddings QUALIFY row_number() OVER (PARTITION BY contig ORDER BY loaded_at DESC) = 1)
            WHERE len(embedding) = 48 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "scores": """SELECT contig, round(v / total, 9) AS viral, round(l / total, 9) AS plasmid, round(a / total, 9) AS prokaryotic, round(e / total, 9) AS eukaryotic FROM (
            SELECT contig, sum(score) AS total, coalesce(sum(score) FILTER (letter = 'V'), 0) AS v, coalesce(sum(score) FILTER (letter = 'L'), 0) AS l,
                   coalesce(sum(score) FILTER (letter = 'A'), 0) AS a, coalesce(sum(score) FILTER (letter = 'E'), 0) AS e
            FROM (SELECT contig, score, right(upper(trim(gene_family)), 1) AS letter FROM lines WHERE score > 0 AND NOT isnan(score)) WHERE letter IN ('V', 'L', 'A', 'E') GROUP BY contig)""",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named views; it may go on with more of them after a comma."""
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{',' if body.lstrip().startswith(',') else ''} {body.lstrip().lstrip(',')}"
