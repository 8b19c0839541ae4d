import gzip
import random

import numpy as np
from pyspark.sql import functions as F

from strandbin.operators import classify
from strandbin.operators.classify import class_scores, load_classifiers, save_classifiers, train_classifiers
from strandbin.operators.kmers import kmer_multi
from strandbin.sources.fasta import fastq_records, read_fasta, read_fastq, write_fasta
from strandbin.sources.tables import read_coverage_tables, read_coverage_tsv, read_paf, read_sam, read_scores, write_scores

TEXT = ">>a one > two\nACGT\nac gt\n\n>\nTTTT\n>b.2\nNN"


def test_records():
    lines = ["@r1 x", "ACGT", "AC", "+", "IIII", "@I", "@r2", "GG", "+r2", "I"]
    assert list(fastq_records(iter(lines))) == [("r1", "ACGTAC", "IIII@I"), ("r2", "GG", None)]


def test_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(TEXT)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(">z\nGATTACA\n")
    got = {tuple(r) for r in read_fasta(spark, str(tmp_path)).collect()}
    assert got == {("a one > two", "ACGTacgt"), ("b.2", "NN"), ("z", "GATTACA")}
    with gzip.open(tmp_path / "q.fastq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\nIIII\n")
    assert [tuple(r) for r in read_fastq(spark, str(tmp_path / "q.fastq.gz")).collect()] == [("r1", "ACGT", "IIII")]


def test_split_scan_round_trip(spark, tmp_path):
    rows = [(f"c{i}", "ACGTN" * i) for i in range(1, 200)] + [("sixty", "A" * 60)]
    df = spark.createDataFrame(rows, "name string, seq string").repartition(3)
    write_fasta(df, str(tmp_path / "out"), "name", "seq")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {tuple(r) for r in read_fasta(spark, str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == set(rows)
    assert all(len(x["value"]) <= 60 and x["value"] for x in spark.read.text(str(tmp_path / "out")).collect())


def test_text_tables(spark, tmp_path):
    good = "p:F\t0\t0\t0\t+\tc\t100\t0\t50\t5\t10"
    (tmp_path / "a.paf").write_text(f"# x\n\n{good}\n{good.replace('100', 'x')}\nshort\t1\n{good}\textra\n")
    assert [r["target_length"] for r in read_paf(spark, str(tmp_path / "a.paf")).collect()] == [100, 100]
    (tmp_path / "c.tsv").write_text("a\tx\t1.5\na\t2\nb\nc\tbad\nd\t0\n")
    assert {tuple(r) for r in read_coverage_tsv(spark, str(tmp_path / "c.tsv")).collect()} == {("a", 2.0), ("d", 0.0)}
    (tmp_path / "s.tsv").write_text("header\tviral_score\tplas_score\tprokar_score\teukar_score\tpredicted_class\nc\t0.1\t0.2\t0.3\t0.4\teukaryotic\n")
    given = read_scores(spark, str(tmp_path / "s.tsv"))
    assert given.first().asDict() == {"contig": "c", "viral": 0.1, "plasmid": 0.2, "prokaryotic": 0.3, "eukaryotic": 0.4, "predicted_class": "eukaryotic"}
    write_scores(given.drop("predicted_class"), str(tmp_path / "again"))
    assert read_scores(spark, str(tmp_path / "again")).collect() == given.collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.tsv").write_text("a\t1\nb\t5\n")
    (tmp_path / "d" / "2.tsv").write_text("a\t2\n")
    assert {tuple(r) for r in read_coverage_tsv(spark, str(tmp_path / "d")).collect()} == {("a", 2.0), ("b", 5.0)}
    both = read_coverage_tables(spark, [str(tmp_path / "d" / f"{i}.tsv") for i in (1, 2)])
    assert {tuple(r) for r in both.collect()} == {("1", "a", 1.0), ("1", "b", 5.0), ("2", "a", 2.0)}
    tail = "*\t0\t0\t*\t*"
    sam = ["@HD\tVN:1.6", f"r\t0\tc\t11\t60\t5S10M2D5M3I2N4M\t{tail}", f"u\t4\t*\t0\t0\t*\t{tail}", f"d\t1024\tc\t1\t60\t9M\t{tail}"]
    (tmp_path / "r.sam").write_text("\n".join(sam) + "\n")
    got = sorted((r["start"], r["end"]) for r in read_sam(spark, str(tmp_path / "r.sam"), "s").collect())
    assert got == [(10, 20), (22, 27), (29, 33)]


def test_classifier(spark, tmp_path):
    """Two kinds of sequence that differ in their longer k-mers; half of them are held out."""
    r = random.Random(2)

    def seq(words, n):
        return "".join(r.choice(words) for _ in range(n))

    kinds = (["ATTATAA", "GCCGGCG", "ACGTTGC"], ["ATTAATA", "GCCGCGG", "ACGTGTC"])
    rows = [(f"{label}{i}", seq(kinds[label], 40 + (300 if i % 4 == 0 else 0)), label * 3) for label in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "contig string, seq string, label int")
    held = F.substring("contig", 2, 9).cast("int") % 2 == 1
    models = train_classifiers(df.where(~held), "contig", "seq", "label")
    assert set(models) == {500, 1000}
    save_classifiers(models, str(tmp_path / "models"))
    rest = df.where(held).unionByName(spark.createDataFrame([("long", seq(kinds[1], 2000), 3), ("short", "AC", 0)], df.schema))
    got = class_scores(rest, "contig", "seq", load_classifiers(str(tmp_path / "models")))
    same = {tuple(x) for x in class_scores(rest, "contig", "seq", models).collect()}
    assert {tuple(x) for x in got.collect()} == same
    right = got.join(rest.where("contig <> 'short'"), "contig").where((F.col("eukaryotic") > F.col("viral")) == (F.col("label") == 3)).count()
    assert right >= 0.95 * 41 and got.count() == rest.count()


def test_classifier_features_and_scores_are_those_of_the_library(spark):
    """Features against the k-mer shares of ``kmer_multi``, scores against the models' own ``transform``; tables are built once."""
    r = random.Random(5)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for n in (3, 6, 7, 90, 400, 700, 900, 1500, 9000)] + ["ACGTN" * 30, "acgtacgtt", "", "N"]
    df = spark.createDataFrame([(f"c{i}", s, i % 3) for i, s in enumerate(seqs)], "contig string, seq string, label int")
    counted = []
    index = classify.canonical_index

    def once(k, alphabet):
        counted.append(k)
        return index(k, alphabet)

    classify.canonical_index = once
    try:
        rows = classify._features(df.withColumn("label", F.substring("contig", 2, 9).cast("int")), "seq", "label")
        got = {int(x["label"]): x["features"] for x in rows.collect()}
    finally:
        classify.canonical_index = index
    assert sorted(counted) == list(classify.MULTI_K)  # the driver alone, not a call for each row
    want = {i: {} for i in range(len(seqs))}
    start = 0
    for k in classify.MULTI_K:
        for x in kmer_multi(df, "contig", "seq", (k,)).collect():
            want[int(x["contig"][1:])].update(zip([p + start for p in x["places"]], x["freqs"]))
        start += int(index(k, classify.CLASSIFIER_ALPHABET).max()) + 1
    assert {i: dict(zip(v.indices.tolist(), v.values.tolist())) for i, v in got.items()} == want and all(v.size == start for v in got.values())
    models = train_classifiers(df, "contig", "seq", "label")
    scores = {x["contig"]: (x["scale"], x["probabilities"]) for x in classify.classify(df, "contig", "seq", models).collect()}
    assert len(scores) == len(seqs)
    for name, (scale, p) in scores.items():
        near = min(models, key=lambda s: abs(classify.SCALES.index(s) - classify.SCALES.index(scale)))
        assert np.allclose(p, models[near].predictProbability(got[int(name[1:])]).toArray(), rtol=0, atol=1e-12)
