"""Queries over depth and coverage: alignment lines are the reads of three samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbin.operators import coverage as c
from strandbin.operators.kmers import kmer_profiles
from strandbin.operators.skew import join_by_key
from strandbin.plans.views import SAMPLES, alignments, fragments, lengths, with_views
from strandbin.runtime import stage, table

#: Parts into which the fragments of a contig are put to meet its sequence.
SPREAD = 64
NAMES = [f"{s}_coverage{x}" for s in SAMPLES for x in ("", "_std")]


def reads_per_sample(spark: SparkSession, folder: str) -> DataFrame:
    return c.reads_per_sample(alignments(spark, folder))


def header_map(spark: SparkSession, folder: str) -> DataFrame:
    """The assignment table's contig names, looked up among the contigs."""
    return c.map_names(table(spark, folder, "clusters_df").withColumnRenamed("contig", "name"), "name", table(spark, folder, "fragments_dict"), "contig")


def depth_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return c.depth_intervals(alignments(spark, folder))


def frag_clamp(spark: SparkSession, folder: str) -> DataFrame:
    return c.clamp_fragments(fragments(spark, folder), lengths(spark, folder))


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    return c.fragment_coverage(alignments(spark, folder), frag_clamp(spark, folder), SAMPLES)


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in columns})


def fragment_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_coverage(spark, folder), ["mean", "std"])


def uncovered_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments on whose bases no read of any sample lies, those without a valid interval included."""
    covered = _coverage(spark, folder).where("mean > 0").select("fragment").distinct()
    return fragments(spark, folder).select("fragment").distinct().join(covered, "fragment", "left_anti")


def _rpm(spark: SparkSession, folder: str) -> DataFrame:
    return c.per_million(_coverage(spark, folder), reads_per_sample(spark, folder))


def coverage_rpm(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_rpm(spark, folder), ["mean", "std"])


def coverage_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(c.pivot_samples(_rpm(spark, folder), SAMPLES), NAMES)


def zero_cov_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "features").where(c.any_coverage(NAMES)).select("fragment").distinct()


def coverage_log(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(c.log_scaled(_rpm(spark, folder)), ["mean", "std"])


def _zscore(spark: SparkSession, folder: str) -> DataFrame:
    wide = c.pivot_samples(_rpm(spark, folder), SAMPLES).where(c.any_coverage(NAMES))
    return c.standardised(stage(wide.withColumns({n: F.log1p(n) for n in NAMES}), "wide"), NAMES)


def coverage_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_zscore(spark, folder), NAMES)


def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The 136 k-mer shares and the scaled coverage of every fragment with coverage, assembled from sequences and reads."""
    dna = table(spark, folder, "fragments_dict").unionByName(table(spark, folder, "control_contigs")).where("sequence is not null")
    valid = stage(frag_clamp(spark, folder).where("valid").select("contig", F.struct("start", "end", "fragment").alias("f")), "valid")
    spans = valid.groupBy("contig", F.pmod(F.xxhash64("f"), F.lit(SPREAD)).alias("part")).agg(F.collect_list("f").alias("spans"))
    seqs = dna.groupBy("contig").agg(F.max("sequence").alias("seq"))
    pieces = join_by_key(spans, seqs, "contig").select("seq", F.explode("spans").alias("f"))
    shares = kmer_profiles(pieces.select("f.fragment", F.expr("substring(seq, f.start + 1, f.end - f.start)").alias("piece")), "fragment", "piece")
    joined = shares.join(_zscore(spark, folder), "fragment")
    return _rounded(joined.select("fragment", *[F.col("profile")[i].alias(f"kmer_{i}") for i in range(136)], *NAMES), [*[f"kmer_{i}" for i in range(136)], *NAMES])


QUERIES = {f.__name__: f for f in (reads_per_sample, header_map, depth_intervals, frag_clamp, fragment_coverage, uncovered_fragments, coverage_rpm, coverage_pivot, zero_cov_filter, coverage_log, coverage_zscore, feature_matrix)}

# Means over 2^n bases can lie halfway between two roundings; doubles are rounded to even here, decimals upwards as in Spark.
_HALF_UP = "round({}::DECIMAL(28, 12), 6)::DOUBLE"
_CLAMP = """clamped AS (SELECT fragment, contig, CASE WHEN ok THEN start_pos ELSE 0 END::INT AS s, CASE WHEN ok THEN e ELSE 0 END::INT AS e, ok FROM (
            SELECT fragment, contig, start_pos, least(start_pos + f.length, l.length) AS e,
                   coalesce(start_pos >= 0 AND start_pos < l.length AND least(start_pos + f.length, l.length) > start_pos AND f.length > 0, false) AS ok
            FROM frags f LEFT JOIN lengths l USING (contig)))"""
# Every run of equal depth that a fragment meets, weighted by the bases they share; the Spark plan has no such join.
_COVER = f"""{_CLAMP}, samples AS (SELECT unnest(['s1', 's2', 's3']) AS sample),
        events AS (SELECT sample, contig, pos, sum(d) AS d FROM (SELECT sample, contig, start AS pos, 1 AS d FROM reads WHERE stop > start UNION ALL SELECT sample, contig, stop, -1 FROM reads WHERE stop > start) GROUP BY ALL HAVING sum(d) <> 0),
        runs AS (SELECT sample, contig, pos AS s, lead(pos) OVER w AS e, (sum(d) OVER w)::DOUBLE AS depth FROM events WINDOW w AS (PARTITION BY sample, contig ORDER BY pos)),
        met AS (SELECT r.sample, c.fragment, sum(depth * (least(r.e, c.e) - greatest(r.s, c.s))) AS a1, sum(depth * depth * (least(r.e, c.e) - greatest(r.s, c.s))) AS a2
            FROM clamped c JOIN runs r ON r.contig = c.contig AND r.s < c.e AND r.e > c.s WHERE c.ok AND r.depth > 0 GROUP BY ALL),
        cover AS (SELECT sample, fragment, coalesce(a1 / n, 0.0) AS mean, sqrt(greatest(coalesce(a2 / n - (a1 / n) ** 2, 0.0), 0.0)) AS std
            FROM (SELECT fragment, (e - s)::DOUBLE AS n FROM clamped) CROSS JOIN samples LEFT JOIN met USING (sample, fragment)),
        rpm AS (SELECT sample, fragment, mean / (n / 1e6::DOUBLE) AS mean, std / (n / 1e6::DOUBLE) AS std FROM cover JOIN (SELECT sample, count(*) AS n FROM reads GROUP BY sample) USING (sample)),
        wide AS (SELECT fragment, {', '.join(f"max(CASE WHEN sample = '{s}' THEN {v} END) AS {s}_coverage{x}" for s in SAMPLES for v, x in (('mean', ''), ('std', '_std')))} FROM rpm GROUP BY fragment),
        logged AS (SELECT fragment, {', '.join(f'ln(1 + {n}) AS {n}' for n in NAMES)} FROM wide WHERE {' OR '.join(f'{n} <> 0' for n in NAMES)}),
        z AS (SELECT fragment, {', '.join(f'coalesce(({n} - avg({n}) OVER ()) / nullif(stddev_pop({n}) OVER (), 0), 0) AS {n}' for n in NAMES)} FROM logged)"""
_V = "lengths frags lines reads"
_R = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in NAMES)

SQL = {
    "reads_per_sample": with_views("lines reads", "SELECT sample, count(*) AS reads FROM reads GROUP BY sample"),
    "header_map": r"""WITH names AS (SELECT DISTINCT contig AS name FROM clusters_df), known AS (SELECT DISTINCT contig FROM fragments_dict),
        t AS (SELECT name, name AS c1, regexp_extract(trim(name), '^\S+') AS c2, regexp_extract(name, '^(.*)\.[^.]*$', 1) AS c3 FROM names)
        SELECT name, coalesce(a.contig, b.contig, c.contig) AS contig,
               CASE WHEN a.contig IS NOT NULL THEN 'exact' WHEN b.contig IS NOT NULL THEN 'first word' WHEN c.contig IS NOT NULL THEN 'before dot' END AS how
        FROM t LEFT JOIN known a ON a.contig = c1 LEFT JOIN known b ON b.contig = c2 LEFT JOIN known c ON c.contig = c3""",
    "depth_intervals": with_views("lines reads", """, e AS (SELECT sample, contig, pos, sum(d) AS d FROM (SELECT sample, contig, start AS pos, 1 AS d FROM reads WHERE stop > start UNION ALL SELECT sample, contig, stop, -1 FROM reads WHERE stop > start) GROUP BY ALL HAVING sum(d) <> 0)
        SELECT sample, contig, start, stop AS "end", depth FROM (SELECT sample, contig, pos AS start, lead(pos) OVER w AS stop, (sum(d) OVER w)::BIGINT AS depth FROM e WINDOW w AS (PARTITION BY sample, contig ORDER BY pos)) WHERE depth > 0"""),
    "frag_clamp": with_views("lengths frags", f', {_CLAMP} SELECT fragment, contig, s AS start, e AS "end", ok AS valid FROM clamped'),
    "fragment_coverage": with_views(_V, f", {_COVER} SELECT sample, fragment, {_HALF_UP.format('mean')} AS mean, {_HALF_UP.format('std')} AS std FROM cover"),
    "uncovered_fragments": with_views(_V, f", {_CLAMP} SELECT DISTINCT fragment FROM frags ANTI JOIN (SELECT c.fragment FROM clamped c JOIN reads r ON r.contig = c.contig AND r.start < c.e AND r.stop > c.s AND r.stop > r.start WHERE c.ok) USING (fragment)"),
    "coverage_rpm": with_views(_V, f", {_COVER} SELECT sample, fragment, {_HALF_UP.format('mean')} AS mean, {_HALF_UP.format('std')} AS std FROM rpm"),
    "coverage_pivot": with_views(_V, f", {_COVER} SELECT fragment, {_R} FROM wide"),
    "zero_cov_filter": f"SELECT DISTINCT fragment FROM features WHERE {' OR '.join(f'coalesce({n}, 0) <> 0' for n in NAMES)}",
    "coverage_log": with_views(_V, f", {_COVER} SELECT sample, fragment, round(ln(1 + mean), 6) AS mean, round(ln(1 + std), 6) AS std FROM rpm"),
    "coverage_zscore": with_views(_V, f", {_COVER} SELECT fragment, {_R} FROM z"),
}
