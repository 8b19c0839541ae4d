"""The whole run: ``python -m strandbin --fasta contigs.fa --alignments reads/ --out FOLDER``, or over the project's tables."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbin.functions.rules import first_word, gene_family
from strandbin.operators.classify import CLASSES, class_scores, load_classifiers, save_classifiers, train_classifiers
from strandbin.operators.coverage import map_names
from strandbin.params import Params
from strandbin.plans import views
from strandbin.plans.run import run, write
from strandbin.sources.bam import read_bam
from strandbin.sources.fasta import read_fasta
from strandbin.sources.tables import file_stem, read_coverage_tables, read_paf, read_sam, read_scores


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that paths and patterns name, each once and sorted; one that names none is an error."""
    found: set[str] = set()
    for p in paths:
        files = spark.read.format("binaryFile").load(p).select("path").collect()  # names only; the contents are not read
        if not files:
            raise FileNotFoundError(p)
        found |= {r["path"] for r in files}
    return sorted(found)


def contigs_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``contig, seq`` in upper case; of contigs with the same first word in their header the longest."""
    rows = read_fasta(spark, expand(spark, paths)).select(first_word(F.col("header")).alias("contig"), F.upper("seq").alias("seq"))
    return rows.groupBy("contig").agg(F.max_by("seq", F.struct(F.length("seq"), "seq")).alias("seq"))


def reads_of(spark: SparkSession, paths: list[str], contigs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """Reads of BAM and SAM files (a sample each) under the contigs' names, and the samples."""
    files = expand(spark, paths)
    parts = [read_sam(spark, f, file_stem(f)) if f.endswith((".sam", ".sam.gz")) else read_bam(spark, f) for f in files]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    mapped = map_names(contigs.select("contig"), "contig", rows.withColumnRenamed("contig", "reference"), "reference", "reference")
    named = mapped.where("reference is not null").select(F.col("reference").alias("contig"), F.col("contig").alias("own"))
    return rows.join(named, "contig").select("sample", F.col("own").alias("contig"), "start", "end"), tuple(file_stem(f) for f in files)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Protein alignment lines with the gene family of each."""
    return read_paf(spark, path).withColumn("line_no", F.monotonically_increasing_id()).withColumnRenamed("target", "contig").withColumn("gene_family", gene_family(F.col("query")))


def scores_of(spark: SparkSession, args: dict, contigs: DataFrame) -> DataFrame | None:
    """Class scores from a table, from saved models, or from models trained on labels (contig and class, tab-separated)."""
    if args["scores"]:
        return read_scores(spark, args["scores"])
    if args["labels"]:
        given = spark.read.schema("contig string, class string").option("sep", "\t").csv(args["labels"])
        number = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")) - 1
        models = train_classifiers(contigs.join(given.select("contig", number.alias("label")).where("label >= 0"), "contig"), "contig", "seq", "label")
        if args["model"]:
            save_classifiers(models, args["model"])
        return class_scores(contigs, "contig", "seq", models)
    return class_scores(contigs, "contig", "seq", load_classifiers(args["model"])) if args["model"] else None


def arguments(given: list[str] | None = None) -> tuple[dict, Params]:
    parser = argparse.ArgumentParser(prog="strandbin", description=__doc__)
    parser.add_argument("--tables", help="folder of the project's tables, in place of files")
    parser.add_argument("--fasta", nargs="+", help="FASTA files or patterns")
    parser.add_argument("--alignments", nargs="+", help="BAM or SAM files or patterns, one sample each")
    parser.add_argument("--coverage", nargs="+", help="tables of contig and coverage, one sample each, in place of alignments")
    parser.add_argument("--scores", help="table of class scores")
    parser.add_argument("--labels", help="table of contig and class to train a classifier on")
    parser.add_argument("--model", help="folder of saved classifiers; with --labels they are saved there")
    parser.add_argument("--paf", help="protein alignments")
    parser.add_argument("--out", required=True)
    for f in fields(Params):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            parser.add_argument(flag, action="store_true")
        else:
            parser.add_argument(flag, type=float if isinstance(f.default, float) else int, default=f.default)
    args = vars(parser.parse_args(given))
    if bool(args["tables"]) == bool(args["fasta"]):
        parser.error("either --tables or --fasta")
    if args["alignments"] and args["coverage"]:
        parser.error("--alignments or --coverage, not both")
    return args, Params(**{f.name: args[f.name] for f in fields(Params)})


def main(given: list[str] | None = None) -> None:
    args, params = arguments(given)
    spark = SparkSession.builder.appName("strandbin").getOrCreate()
    cover = None
    if args["tables"]:
        contigs, lines = views.contigs(spark, args["tables"]), views.lines(spark, args["tables"])
        alignments, samples = views.alignments(spark, args["tables"]), views.SAMPLES
    else:
        contigs, alignments, samples = contigs_of(spark, args["fasta"]), None, ()
        lines = lines_of(spark, args["paf"]) if args["paf"] else None
        if args["alignments"]:
            alignments, samples = reads_of(spark, args["alignments"], contigs)
        elif args["coverage"]:
            files = expand(spark, args["coverage"])
            cover, samples = read_coverage_tables(spark, files), tuple(file_stem(f) for f in files)
    write(run(contigs, alignments, samples, lines, scores_of(spark, args, contigs), params, cover), args["out"])


if __name__ == "__main__":
    main()
