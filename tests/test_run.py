import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strandbin.__main__ import arguments, expand, main
from strandbin.params import Params
from strandbin.plans import views
from strandbin.plans.run import run, write
from strandbin.streaming.coverage import covered_bases, read_alignments, reads_so_far
from tests.against_sql import FOLDER
from tests.test_bam import _bam, _members


def test_whole_run(spark, tmp_path):
    contigs = views.contigs(spark, FOLDER)
    p = Params(min_contig_length=500, min_bin_size=1_000, enable_chimera_detection=True, embedding_dim=8, cluster_selection_epsilon=0.9, keep_intermediate=True, skip_bacterial_filter=True)
    result = run(contigs, views.alignments(spark, FOLDER), views.SAMPLES, views.lines(spark, FOLDER), views.scores(spark, FOLDER), p)
    write(result, str(tmp_path / "out"))
    bins = spark.read.option("header", True).csv(str(tmp_path / "out" / "bins.csv"))
    assert bins.count() == bins.select("contig").distinct().count() > 0
    sizes = bins.join(contigs, "contig").groupBy("cluster").agg(F.sum(F.length("seq")).alias("n"))
    assert sizes.agg(F.min("n")).first()[0] >= 1_000
    text = spark.read.option("lineSep", "\n>").text(str(tmp_path / "out" / "bins"))
    found = {(re.sub("_duplicated_core_genes$", "", r["bin"]), r["value"].lstrip(">").split("\n")[0]): "".join(r["value"].split("\n")[1:]) for r in text.collect()}
    assert found == {(r["cluster"], r["contig"]): r["seq"] for r in bins.join(contigs, "contig").collect()}
    out = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in ("fragments", "features", "embeddings", "encoder", "coordinates", "quality")}
    assert out["features"].where(F.size("v") != 142).count() == 0 and out["coordinates"].count() == out["embeddings"].count() > 0
    assert out["coordinates"].where("cluster is null").count() == 0 and out["encoder"].count() == 9
    report = json.loads(spark.read.text(str(tmp_path / "out" / "report")).first()["value"])
    assert report["params"]["min_bin_size"] == 1000 and report["filter_rounds"]
    chimeras = spark.read.json(str(tmp_path / "out" / "chimeras"))
    assert chimeras.count() == 0 or {"contig", "f", "p", "is_chimera", "cluster", "count_ratio"} <= set(chimeras.columns)


def _files(folder):
    """Three genomes of their own composition and depth, five contigs each; one contig carries a marker gene twice over."""
    r = random.Random(11)
    weights = {"g0": (6, 1, 1, 6), "g1": (1, 6, 6, 1), "g2": (4, 4, 1, 1)}
    contigs = {f"{g}_{i}{'.1' if g == 'g2' else ''}": "".join(r.choices("ACGT", w, k=2500)) for g, w in weights.items() for i in range(5)}
    contigs["short"] = "ACGT" * 100
    (folder / "a.fa").write_text("".join(f">{n} kind={n[:2]}\n{s[:60]}\n{s[60:].lower()}\n" for n, s in contigs.items() if n[1] != "2"))
    with gzip.open(folder / "b.fa.gz", "wt") as f:
        f.write("".join(f">{n}\n{s}\n" for n, s in contigs.items() if n[1] == "2"))
    depth = {"s1": {"g0": 9, "g1": 2, "g2": 4, "sh": 1}, "s2": {"g0": 1, "g1": 8, "g2": 3, "sh": 1}}
    names = sorted(contigs)
    sam = [f"r\t0\t{n.removesuffix('.1')}\t{r.randrange(1, max(2, len(contigs[n]) - 400))}\t60\t400M\t*\t0\t0\t*\t*" for n in names for _ in range(5 * depth["s1"][n[:2]])]
    (folder / "s1.sam").write_text("\n".join(["@HD\tVN:1.6", *sam]) + "\n")
    reads = [(names.index(n), r.randrange(0, max(1, len(contigs[n]) - 400)), 0, [(400, "M")]) for n in names for _ in range(5 * depth["s2"][n[:2]])]
    (folder / "s2.bam").write_bytes(_members(_bam(reads, [(n.removesuffix(".1"), len(contigs[n])) for n in names]), 5000))
    paf = [f"p{i}:F{i}\t0\t0\t0\t+\t{c}\t2500\t0\t2400\t900\t1000" for i, c in enumerate(("g0_0", "g1_0", "g2_0.1"))]
    (folder / "genes.paf").write_text("\n".join(paf) + "\n")
    scores = ["header\tviral_score\tplas_score\tprokar_score\teukar_score\tpredicted_class", "g2_4.1\t0\t0\t0.9\t0.1\tprokaryotic", "g0_0\t0.1\t0\t0\t0.9\teukaryotic"]
    (folder / "scores.tsv").write_text("\n".join(scores) + "\n")
    for s, of in depth.items():
        (folder / f"{s}.tsv").write_text("".join(f"{n}\tx\t{of[n[:2]]}\n" for n in names))
    return contigs


@pytest.mark.parametrize("given", ["reads", "tables", "none"])
def test_run_from_files(spark, tmp_path, given):
    contigs, out = _files(tmp_path), tmp_path / "out"
    more = {"reads": ["--alignments", f"{tmp_path}/*.sam", f"{tmp_path}/*.bam"], "tables": ["--coverage", f"{tmp_path}/s1.tsv", f"{tmp_path}/s2.tsv"], "none": []}[given]
    main(["--fasta", f"{tmp_path}/*.fa", f"{tmp_path}/*.gz", *more, "--paf", f"{tmp_path}/genes.paf", "--scores", f"{tmp_path}/scores.tsv", "--out", str(out), "--embedding-dim", "2", "--cluster-selection-epsilon", "0.5", "--min-bin-size", "5000"])
    bins = {r["contig"]: r["cluster"] for r in spark.read.option("header", True).csv(str(out / "bins.csv")).collect()}
    assert set(bins) == set(contigs) - {"short", "g2_4.1"}  # too short; bacterial by its score
    assert len({(c[:2], b) for c, b in bins.items()}) == len(set(bins.values())) == 3
    text = spark.read.option("lineSep", "\n>").text(str(out / "bins"))
    assert {(r["bin"], r["value"].lstrip(">").replace("\n", "")) for r in text.collect()} == {(b, c + contigs[c]) for c, b in bins.items()}


def test_arguments(spark, tmp_path):
    with pytest.raises(SystemExit):
        arguments(["--out", "x"])
    with pytest.raises(SystemExit):
        arguments(["--fasta", "a", "--alignments", "b", "--coverage", "c", "--out", "x"])
    for name in ("b.fa", "a.fa"):
        (tmp_path / name).write_text(">x\nA\n")
    assert [f.rsplit("/", 1)[1] for f in expand(spark, [f"{tmp_path}/*.fa", f"{tmp_path}/b.fa"])] == ["a.fa", "b.fa"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|nothing"):
        expand(spark, [f"{tmp_path}/nothing*"])


def test_params():
    with pytest.raises(ValueError):
        Params(min_cluster_size=1)
    assert Params().core_neighbour == 2 and Params(min_samples=7).core_neighbour == 7


def test_streamed_coverage(spark, tmp_path):
    schema = "sample string, contig string, start int, end int"
    reads = spark.createDataFrame([("s", "c", 0, 30), ("s", "c", 10, 20), ("t", "c", 5, 50), ("s", "d", 0, 9)], schema)
    frags = spark.createDataFrame([("f", "c", 5, 15, True), ("g", "c", 40, 60, True), ("h", "c", 0, 0, False)], "fragment string, contig string, start int, end int, valid boolean")
    for part in reads.randomSplit([0.5, 0.5], 1):
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_alignments(spark, str(tmp_path / "in"))
    for name, df in (("bases", covered_bases(stream, frags)), ("reads", reads_so_far(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("bases").collect()} == {("s", "f", 15), ("t", "f", 10), ("t", "g", 10)}
    assert {tuple(r) for r in spark.table("reads").collect()} == {("s", 3), ("t", 1)}
