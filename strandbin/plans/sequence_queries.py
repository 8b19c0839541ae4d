"""Queries over sequences, names and k-mers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbin.functions import dna, rules
from strandbin.operators.coverage import coverage_of_contigs
from strandbin.operators.kmers import kmer_counts, kmer_multi, kmer_profiles, kmer_spectrum
from strandbin.operators.skew import join_by_key
from strandbin.plans.views import contigs, raw_contigs, with_views
from strandbin.runtime import shared_folder, table
from strandbin.sources.fasta import read_fasta
from strandbin.sources.tables import read_coverage_tsv, read_paf

LEAST_LENGTH = 1_000
SPLIT_LENGTH = 5_000


def reverse_complement(spark: SparkSession, folder: str) -> DataFrame:
    return raw_contigs(spark, folder).select("contig", dna.reverse_complement(F.col("seq")).alias("rc")).dropDuplicates(["contig"])


def mer2bits(spark: SparkSession, folder: str) -> DataFrame:
    """Every 6-mer of the contigs with its code and number of windows."""
    spectrum = kmer_spectrum(contigs(spark, folder), "seq", 6)
    kmer = dna.decode(F.col("code"), 6)
    return spectrum.select(kmer.alias("kmer"), dna.encode(kmer).alias("bits"), "windows")


def _index(alphabet: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        index = F.lit(dna.canonical_index(4, alphabet).tolist())
        return kmer_spectrum(contigs(spark, folder), "seq", 4).select(dna.decode(F.col("code"), 4).alias("kmer"), F.get(index, F.col("code").cast("int")).alias("kmer_index"), "windows")

    return query


def valid_alphabet(spark: SparkSession, folder: str) -> DataFrame:
    return raw_contigs(spark, folder).select("contig", dna.only_bases(F.col("seq")).alias("only_bases")).distinct()


def length_scale(spark: SparkSession, folder: str) -> DataFrame:
    return raw_contigs(spark, folder).select("contig", F.length("seq").alias("length")).distinct().withColumn("scale", rules.length_scale(F.col("length")))


def scale_partition(spark: SparkSession, folder: str) -> DataFrame:
    return length_scale(spark, folder).groupBy("scale").agg(F.count(F.lit(1)).alias("contigs"), F.sum("length").alias("bases"))


def base_name(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "fragments").select("fragment").distinct()
    return names.select("fragment", rules.base_name(F.col("fragment")).alias("base"), rules.pair_group(F.col("fragment")).alias("pair_group"))


def fasta_wrap(spark: SparkSession, folder: str) -> DataFrame:
    return raw_contigs(spark, folder).select("contig", F.concat(F.lit(">"), "contig", F.lit("\n"), dna.wrap(F.col("seq"))).alias("record")).dropDuplicates(["contig"])


def half_split(spark: SparkSession, folder: str) -> DataFrame:
    """Midpoints of contigs long enough to be augmented by halves."""
    long_ones = raw_contigs(spark, folder).select("contig", F.length("seq").alias("length")).distinct().where(F.col("length") > SPLIT_LENGTH)
    return long_ones.select("contig", "length", F.expr("cast(length div 2 as int)").alias("midpoint"), F.expr("cast(length - length div 2 as int)").alias("second_half"))


def _fasta_text(spark: SparkSession, folder: str) -> str:
    """The contigs as FASTA files in the shared folder."""
    header = F.concat_ws(" ", F.concat(F.lit(">"), "contig"), F.col("description"))
    rows = table(spark, folder, "fragments_dict").where("sequence is not null").select(F.concat(header, F.lit("\n"), dna.wrap(F.col("sequence"))).alias("value"))
    path = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


def scan_contigs(spark: SparkSession, folder: str) -> DataFrame:
    """A FASTA scan with the length filter."""
    found = read_fasta(spark, _fasta_text(spark, folder)).select(rules.first_word(F.col("header")).alias("contig"), F.length("seq").alias("length"))
    return found.where(F.col("length") >= LEAST_LENGTH).distinct()


def header_clean(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fragments_dict").select(F.concat_ws(" ", "contig", "description").alias("header")).distinct()
    return rows.select("header", rules.first_word(F.col("header")).alias("contig"))


def paf_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The alignment lines written as PAF text and read back."""
    rows = table(spark, folder, "best_alignments").select("query", "contig", "target_length", "target_start", "target_end", "matches", "alignment_length").distinct()
    text = rows.select(F.concat_ws("\t", "query", F.lit("0"), F.lit("0"), F.lit("0"), F.lit("+"), "contig", *[F.col(c).cast("string") for c in ("target_length", "target_start", "target_end", "matches", "alignment_length")]).alias("value"))
    path = f"{shared_folder(spark)}/paf-{uuid.uuid4().hex}"
    text.write.text(path)
    return read_paf(spark, path)


def tsv_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """A table of contigs with a number, written as TSV, looked up for every fragment of each contig.

    The names are those of the assignment table as they are stored, some with additions.
    """
    rows = table(spark, folder, "clusters_df").where("contig is not null").groupBy("contig").agg(F.max("total_core_genes_found").alias("n")).where("n is not null")
    path = f"{shared_folder(spark)}/tsv-{uuid.uuid4().hex}"
    rows.select(F.concat_ws("\t", "contig", F.lit("x"), F.col("n").cast("string")).alias("value")).write.text(path)
    found = coverage_of_contigs(table(spark, folder, "fragments").select("contig").where("contig is not null").distinct(), read_coverage_tsv(spark, path))
    names = table(spark, folder, "fragments").where("contig is not null").select("fragment", "contig").distinct()
    return join_by_key(names, found, "contig").select("fragment", "contig", "coverage")


def kmer4_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = kmer_counts(raw_contigs(spark, folder), "contig", "seq").dropDuplicates(["contig"])
    return counts.select("contig", F.posexplode("counts").alias("kmer_index", "n")).where("n > 0")


def kmer4_profile(spark: SparkSession, folder: str) -> DataFrame:
    shares = kmer_profiles(raw_contigs(spark, folder), "contig", "seq").dropDuplicates(["contig"])
    return shares.select("contig", F.posexplode("profile").alias("kmer_index", "share")).withColumn("share", F.round("share", 6))


def kmer_multi_freq(spark: SparkSession, folder: str) -> DataFrame:
    """Per contig and k: distinct k-mers, the largest share and the sum of squares."""
    found = kmer_multi(raw_contigs(spark, folder), "contig", "seq").dropDuplicates(["contig", "k"])
    square = F.aggregate("freqs", F.lit(0.0), lambda a, x: a + x * x)
    return found.select("contig", "k", F.size("places").alias("distinct_kmers"), F.round(F.coalesce(F.array_max("freqs"), F.lit(0.0)), 6).alias("largest"), F.round(square, 6).alias("squares"))


QUERIES = {
    "reverse_complement": reverse_complement,
    "mer2bits": mer2bits,
    "kmer_index_atgc": _index(dna.PROFILE_ALPHABET),
    "kmer_index_acgt": _index(dna.CLASSIFIER_ALPHABET),
    "valid_alphabet": valid_alphabet,
    "length_scale": length_scale,
    "scale_partition": scale_partition,
    "base_name": base_name,
    "fasta_wrap": fasta_wrap,
    "half_split": half_split,
    "scan_contigs": scan_contigs,
    "header_clean": header_clean,
    "paf_parse": paf_parse,
    "tsv_coverage": tsv_coverage,
    "kmer4_counts": kmer4_counts,
    "kmer4_profile": kmer4_profile,
    "kmer_multi_freq": kmer_multi_freq,
}

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _windows(k: int | str) -> str:
    return f"SELECT contig, substring(seq, p, {k}) AS kmer FROM (SELECT contig, seq, unnest(generate_series(1, length(seq) - {k} + 1)) AS p FROM contigs)"


def _index_table(alphabet: str) -> str:
    code = f"least(translate(kmer, '{alphabet}', '0123'), translate({_RC.format('kmer')}, '{alphabet}', '0123'))"
    words = "SELECT a.c || b.c || d.c || e.c AS kmer FROM l a, l b, l d, l e"
    return f"l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), dim AS (SELECT kmer, (dense_rank() OVER (ORDER BY {code}) - 1)::INT AS kmer_index FROM ({words}))"


def _index_sql(alphabet: str) -> str:
    return with_views("contigs", f", {_index_table(alphabet)}, w AS ({_windows(4)}) SELECT kmer, kmer_index, count(*) AS windows FROM w JOIN dim USING (kmer) GROUP BY kmer, kmer_index")


_SCALE = "(CASE WHEN length <= 750 THEN 500 WHEN length <= 3000 THEN 1000 WHEN length <= 7500 THEN 5000 WHEN length <= 30000 THEN 10000 ELSE 50000 END)::INT"

SQL = {
    "reverse_complement": with_views("contigs", f"SELECT contig, {_RC.format('seq')} AS rc FROM contigs"),
    "mer2bits": with_views("contigs", f""", w AS ({_windows(6)}), k AS (SELECT kmer, count(*) AS windows FROM w WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer)
        SELECT kmer, list_reduce([(instr('ACGT', kmer[i]) - 1)::BIGINT for i in generate_series(1, 6)], lambda a, x: a * 4 + x) AS bits, windows FROM k"""),
    "kmer_index_atgc": _index_sql(dna.PROFILE_ALPHABET),
    "kmer_index_acgt": _index_sql(dna.CLASSIFIER_ALPHABET),
    "valid_alphabet": with_views("contigs", "SELECT contig, NOT regexp_matches(seq, '[^ACGT]') AS only_bases FROM contigs"),
    "length_scale": with_views("contigs", f"SELECT contig, length, {_SCALE} AS scale FROM (SELECT contig, length(seq)::INT AS length FROM contigs)"),
    "scale_partition": with_views("contigs", f"SELECT {_SCALE} AS scale, count(*) AS contigs, sum(length)::BIGINT AS bases FROM (SELECT contig, length(seq)::INT AS length FROM contigs) GROUP BY 1"),
    "base_name": r"""SELECT DISTINCT fragment,
        CASE WHEN regexp_full_match(fragment, '.+\.h[12]\.\d+') THEN regexp_extract(fragment, '^(.+)\.h[12]\.\d+$', 1)
             WHEN regexp_full_match(fragment, '.+\.(?:\d+|original)') THEN regexp_extract(fragment, '^(.+)\.(?:\d+|original)$', 1) ELSE fragment END AS base,
        CASE WHEN regexp_full_match(fragment, '.+\.(?:h[12]\.\d+|\d+|original)') THEN regexp_extract(fragment, '^(.+)\.(?:h[12]\.\d+|\d+|original)$', 1) ELSE fragment END AS pair_group
        FROM fragments""",
    "fasta_wrap": with_views("contigs", r"SELECT contig, '>' || contig || chr(10) || rtrim(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), chr(10)) AS record FROM contigs"),
    "half_split": with_views("contigs", "SELECT contig, length, length // 2 AS midpoint, length - length // 2 AS second_half FROM (SELECT contig, length(seq)::INT AS length FROM contigs) WHERE length > 5000"),
    "scan_contigs": with_views("contigs", "SELECT contig, length(seq)::INT AS length FROM contigs WHERE length(seq) >= 1000"),
    "header_clean": r"SELECT DISTINCT concat_ws(' ', contig, description) AS header, regexp_extract(trim(concat_ws(' ', contig, description)), '^\S+') AS contig FROM fragments_dict",
    "paf_parse": "SELECT DISTINCT query, contig AS target, target_length, target_start, target_end, matches, alignment_length FROM best_alignments WHERE target_length IS NOT NULL",
    "tsv_coverage": r"""WITH t AS (SELECT contig AS name, max(total_core_genes_found)::DOUBLE AS n FROM clusters_df WHERE contig IS NOT NULL GROUP BY contig HAVING n IS NOT NULL),
        w AS (SELECT regexp_extract(trim(name), '^\S+') AS first, arg_min(n, name) AS n FROM t GROUP BY first)
        SELECT f.fragment, f.contig, coalesce(t.n, w.n, 0.0) AS coverage FROM (SELECT DISTINCT fragment, contig FROM fragments WHERE contig IS NOT NULL) f LEFT JOIN t ON t.name = f.contig LEFT JOIN w ON w.first = f.contig""",
    "kmer4_counts": with_views("contigs", f", {_index_table('ATGC')}, w AS ({_windows(4)}) SELECT contig, kmer_index, count(*)::INT AS n FROM w JOIN dim USING (kmer) GROUP BY contig, kmer_index"),
    "kmer4_profile": with_views("contigs", f""", {_index_table('ATGC')}, w AS ({_windows(4)}), n AS (SELECT contig, kmer_index, count(*) AS n FROM w JOIN dim USING (kmer) GROUP BY contig, kmer_index),
        grid AS (SELECT contig, i::INT AS kmer_index FROM contigs, generate_series(0, 135) g(i)), t AS (SELECT contig, sum(n) AS t FROM n GROUP BY contig)
        SELECT contig, kmer_index, round((coalesce(n, 0) + 1e-5::DOUBLE) / (coalesce(t, 0) + 136 * 1e-5::DOUBLE), 6) AS share FROM grid LEFT JOIN n USING (contig, kmer_index) LEFT JOIN t USING (contig)"""),
    "kmer_multi_freq": with_views("contigs", f""", clean AS (SELECT contig, seq FROM contigs WHERE NOT regexp_matches(seq, '[^ACGT]')), ks AS (SELECT unnest([3, 4, 5, 6, 7]) AS k),
        w AS (SELECT contig, k, substring(seq, p, k) AS kmer FROM (SELECT contig, seq, k, unnest(generate_series(1, length(seq) - k + 1)) AS p FROM clean, ks)),
        n AS (SELECT contig, k, least(kmer, {_RC.format('kmer')}) AS kmer, count(*) AS n FROM w GROUP BY ALL),
        s AS (SELECT contig, k, count(*) AS distinct_kmers, max(n) / sum(n)::DOUBLE AS largest, sum(n * n) / (sum(n)::DOUBLE * sum(n)) AS squares FROM n GROUP BY contig, k)
        SELECT c.contig, ks.k::INT AS k, coalesce(distinct_kmers, 0)::INT AS distinct_kmers, round(coalesce(largest, 0.0), 6) AS largest, round(coalesce(squares, 0.0), 6) AS squares
        FROM contigs c CROSS JOIN ks LEFT JOIN s ON s.contig = c.contig AND s.k = ks.k"""),
}
