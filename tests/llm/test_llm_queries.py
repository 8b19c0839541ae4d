import pytest

from strandbin.llm import queries
from tests.against_sql import FOLDER, check


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name])


def _rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()]


def test_queries_without_sql_are_all_tested_here():
    assert set(queries.QUERIES) - set(queries.SQL) == {"p2_clusters", "p3_recall", "p5_posts", "p6_found", "p6_leaks", "p7_mixture", "p8_found", "p8_parts"}


def test_peaks_divide_the_clusters(spark):
    found = _rows(spark, "p2_clusters")
    assert sum(r["contigs"] for r in found) == len(_rows(spark, "p2_found"))
    assert all(len(r["typical_contigs"].split(",")) == min(3, r["contigs"]) for r in found)


def test_recall(spark):
    assert all(r["recall"] is None or r["recall"] >= 0.99 for r in _rows(spark, "p3_recall"))


def test_pieces_cover_every_long_post(spark):
    pieces = {}
    for r in sorted(_rows(spark, "p5_posts"), key=lambda r: (r["doc_id"], r["piece_no"])):
        pieces.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    sizes = {r["doc_id"]: len(r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) > 1200").collect()}
    assert set(pieces) == set(sizes)
    for doc, own in pieces.items():
        assert own[0][0] == 0 and own[-1][1] == sizes[doc] and all(0 < e - s <= 1200 for s, e in own)
        assert all(b[0] == a[1] - 100 for a, b in zip(own, own[1:]))


def test_leaks_are_verbatim_or_retold(spark):
    leaks = _rows(spark, "p6_leaks")
    assert {(r["doc_id"], r["item_id"]) for r in leaks if r["kind"] == "verbatim"} == {(r["doc_id"], r["item_id"]) for r in _rows(spark, "p6_found")}
    assert all(r["run"] >= 13 or (r["answered"] and r["in_order"] >= 0.6) for r in leaks)


def test_shares_of_the_mixture(spark):
    got = _rows(spark, "p7_mixture")
    targets = {r["source"]: r for r in spark.read.parquet(f"{FOLDER}/mix_targets.parquet").collect()}
    assert {r["source"] for r in got} == set(targets) and sum(r["reached_share"] for r in got) == pytest.approx(1)
    assert all(r["most_repeats"] <= targets[r["source"]]["max_repeats"] for r in got)


def test_languages_of_posts_come_from_their_parts(spark):
    words = {}
    for r in _rows(spark, "p8_parts"):
        assert 0 < r["confidence"] <= 1
        words[r["doc_id"], r["lang"]] = words.get((r["doc_id"], r["lang"]), 0) + r["words"]
    given = {r["doc_id"]: (r["lang"] or "")[:2].lower() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    counts = {}
    for (doc, lang), n in words.items():
        if n >= 20:
            counts.setdefault(doc, set()).add(lang)
    want = {(d, x) for d, own in counts.items() for x in own if len(own) > 1 or given[d] not in own}
    assert {(r["doc_id"], r["lang"]) for r in _rows(spark, "p8_found")} == want
