"""Queries of problem 1 over fragments (by contig) and clusters_df (by bin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbin.operators.skew import heavy_keys, number_rows, split_key_summary
from strandbin.runtime import table


def _tables(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, str, str]]:
    """Name, table, key and secondary order of each."""
    fragments = table(spark, folder, "fragments").select("contig", "start_pos")
    bins = table(spark, folder, "clusters_df").select(F.lower(F.trim("cluster")).alias("cluster"), "contig")
    return [("fragments", fragments, "contig", "start_pos"), ("clusters_df", bins, "cluster", "contig")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [heavy_keys(df, key, order, scanned=True).select(F.lit(name).alias("tbl"), F.col("key").alias("key_value")) for name, df, key, order in _tables(spark, folder)]
    return parts[0].unionByName(parts[1])


def p1_contig_summary(spark: SparkSession, folder: str) -> DataFrame:
    _, df, key, order = _tables(spark, folder)[0]
    return split_key_summary(df, key, order, scanned=True).select(
        F.col("key").alias("contig"),
        "row_count",
        F.col("distinct_values").alias("distinct_starts"),
        F.col("first_value").cast("long").alias("first_start"),
        F.col("last_value").cast("long").alias("last_start"),
        F.col("max_step").cast("long").alias("widest_step"),
    )


def p1_bin_summary(spark: SparkSession, folder: str) -> DataFrame:
    _, df, key, order = _tables(spark, folder)[1]
    return split_key_summary(df, key, order, scanned=True).select(F.col("key").alias("bin"), "row_count", F.col("distinct_values").alias("contigs"), F.col("first_value").alias("first_contig"), F.col("last_value").alias("last_contig"))


def p1_fragment_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The number of each fragment within its contig by start and name, rows that were sent twice once."""
    rows = table(spark, folder, "fragments").select("contig", "start_pos", "fragment").distinct()
    return number_rows(rows, "contig", ["start_pos", "fragment"])


QUERIES = {"p1_fragment_numbers": p1_fragment_numbers, "p1_found": p1_found, "p1_contig_summary": p1_contig_summary, "p1_bin_summary": p1_bin_summary}

SQL = {
    "p1_fragment_numbers": """
        SELECT contig, start_pos, fragment, row_number() OVER (PARTITION BY contig ORDER BY start_pos NULLS FIRST, fragment) - 1 AS row_no
        FROM (SELECT DISTINCT contig, start_pos, fragment FROM fragments WHERE contig IS NOT NULL)""",
    "p1_found": """
        SELECT 'fragments' AS tbl, contig AS key_value FROM fragments WHERE contig IS NOT NULL GROUP BY contig
        HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM fragments)
        UNION ALL
        SELECT 'clusters_df', lower(trim(cluster)) FROM clusters_df WHERE cluster IS NOT NULL GROUP BY lower(trim(cluster))
        HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM clusters_df)""",
    "p1_contig_summary": """
        SELECT contig, count(*) AS row_count, count(DISTINCT start_pos) AS distinct_starts,
               min(start_pos)::BIGINT AS first_start, max(start_pos)::BIGINT AS last_start, max(step)::BIGINT AS widest_step
        FROM (SELECT contig, start_pos, start_pos - lag(start_pos) OVER (PARTITION BY contig ORDER BY start_pos NULLS FIRST) AS step FROM fragments)
        WHERE contig IS NOT NULL GROUP BY contig""",
    "p1_bin_summary": """
        SELECT lower(trim(cluster)) AS bin, count(*) AS row_count, count(DISTINCT contig) AS contigs, min(contig) AS first_contig, max(contig) AS last_contig
        FROM clusters_df WHERE cluster IS NOT NULL GROUP BY lower(trim(cluster))""",
}
