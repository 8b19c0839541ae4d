import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandbin.llm import language, leaks, mixture
from strandbin.llm.language import fit, label_documents, label_parts, sentences_of
from strandbin.llm.leaks import RUN, _bounds, common_subsequence, find_leaks, longest_run, words_of
from strandbin.llm.mixture import Node, allot, leaf_sizes, mixture_report, plan, select, shortfalls
from tests.against_sql import FOLDER

ITEM = "The zorkal marker of strain belvun was placed beside the tikro locus after nine rounds of growth in plain broth and then it was lost again"


def test_words():
    text = "&gt; Café <b>Straße</b>, re​gión\n[quote=\"x1\"]&eacute;t&eacute;[/quote] v2.0_a"
    assert words_of(text) == ["cafe", "strasse", "region", "ete", "v2", "0", "a"]
    assert words_of(None) == words_of("") == words_of("<br> ... ") == []


def test_every_run_holds_a_window():
    for n in range(1, 60):
        start, end, text = _bounds(np.array([7, 0, n]))
        own = [(a - 7, e - 7) for a, e, t in zip(start, end, text) if t == 2]
        assert all(any(a <= s and e <= a + RUN for s, e in own) for a in range(n - RUN + 1))
        assert all(0 <= s < e <= n for s, e in own) and own


def test_runs_and_subsequences():
    r = random.Random(1)
    for _ in range(60):
        a, b = [r.randrange(-1, 4) for _ in range(r.randrange(1, 15))], [r.randrange(4) for _ in range(r.randrange(1, 15))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run = 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                run = max(run, k)
        assert common_subsequence(np.array(a), np.array(b)) == table[-1][-1]
        assert longest_run(np.array(a), np.array(b)) == run


def test_leaks(spark):
    w = ITEM.split()
    filler = "some other words that have nothing to do with any of this at all really".split()
    docs = {
        1: " ".join(filler + w[3:16] + filler),
        2: " ".join(filler + w[3:15] + filler),
        3: "> " + "\n> ".join(w).upper(),
        4: " ".join(w[:6] + ["very"] + w[6:11] + ["indeed"] + w[11:20] + ["so"] + w[20:]),
        5: " ".join(filler),
        6: None,
        7: "",
        8: " ".join((filler * 3000) + w[5:18] + filler),
        9: " ".join(w[i] + ("&nbsp;" if i % 2 else "<br>") for i in range(len(w))),
    }
    frame = spark.createDataFrame([(k, v, 1, b"") for k, v in docs.items()] + [(1, docs[1], 1, b"")], "doc_id long, text string, item_id int, words binary")
    items = spark.createDataFrame([(10, ITEM), (11, "An entirely different question about the weather in the hills of the north and who measured it there first"), (12, None), (13, "")], "item_id long, text string")
    got = find_leaks(frame, items).collect()
    assert sorted(r["doc_id"] for r in got if r["run"] >= RUN) == [1, 3, 8, 9]
    assert {r["item_id"] for r in got} == {10}
    assert [(r["doc_id"], r["answered"]) for r in got if r["run"] < RUN] == [(4, True)]
    assert find_leaks(frame.limit(0), items).count() == 0 and find_leaks(frame, items.limit(0)).count() == 0


def test_paraphrase_beside_a_more_similar_passage(spark):
    w = ITEM.split()
    filler = "some other words that have nothing to do with any of this at all really".split()
    told = w[:6] + ["very"] + w[6:11] + ["indeed"] + w[11:20] + ["so"] + w[20:]
    docs = {1: w[3:15] + filler * 5 + told + filler, 2: told + filler * 5 + w[3:15], 3: w[3:15] + filler * 5 + w[15:], 4: told}
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    got = find_leaks(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["run"], r["answered"]) for r in got) == [(1, 0, True), (2, 0, True), (4, 0, True)]


def test_leaks_in_long_texts_and_common_words(spark):
    filler = "some other words that have nothing to do with any of this at all really".split()
    # The leaked words are the corpus' most frequent, and runs lie across the edges of parts.
    rows = [(n, " ".join((filler * 1400)[:n] + ITEM.split()[4:17] + filler)) for n in [*range(20, 40), *range(19_960, 20_010)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in find_leaks(docs, items).collect() if r["run"] >= RUN) == [n for n, _ in rows]


def test_long_texts_are_judged_as_one(spark):
    w, filler = ITEM.split(), "some other words that have nothing to do with any of this at all really".split()
    told = w[:6] + ["very"] + w[6:11] + ["indeed"] + w[11:20] + ["so"] + w[20:]
    rows = [(n, " ".join((filler * 3000)[:n] + passage + filler)) for n in (9, 19_960, 19_975, 19_984, 39_970) for passage in (told, w)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["run"], r["in_order"], r["answered"]) for r in got) == [(i, len(w) if i % 2 else 0, 1.0, True) for i in range(10)]


def test_tags_of_any_length_are_no_words(spark):
    w = ITEM.split()
    link = f'<a href="http://x.y/{"z/" * 300}">'
    quote = f'[quote={"name " * 120}]'
    docs = spark.createDataFrame([(1, " ".join(w[3:9] + [link] + w[9:12] + [quote] + w[12:16]))], "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["run"]) for r in got] == [(1, 13)]


def test_slices_of_items_change_nothing(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/eval_items.parquet")
    whole = sorted(map(tuple, find_leaks(docs, items).withColumn("cosine", F.round("cosine", 4)).collect()))
    monkeypatch.setattr(leaks, "ITEMS_AT_ONCE", 40)
    assert sorted(map(tuple, find_leaks(docs, items).withColumn("cosine", F.round("cosine", 4)).collect())) == whole and whole


def test_a_given_answer_must_be_there(spark):
    w = ITEM.split()
    told = w[:6] + ["very"] + w[6:11] + ["indeed"] + w[11:20] + ["so"] + w[20:]
    docs = spark.createDataFrame([(1, " ".join(told)), (2, " ".join([*told, "Quimber", "Falls"])), (3, " ".join([*told, "quimber"]))], "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM, "quimber falls")], "item_id long, text string, answer string")
    assert {r["doc_id"] for r in find_leaks(docs, items, answer="answer").collect()} == {2}
    assert {r["doc_id"] for r in find_leaks(docs, items).collect()} == {1, 2, 3}


def test_recall_of_paraphrases(spark):
    """Every item, retold: a word in five is dropped or replaced, a word put in between now and then."""
    r = random.Random(3)
    items = spark.read.parquet(f"{FOLDER}/eval_items.parquet")
    rows, wrong = [], []
    for i in items.collect():
        w, told = words_of(i["text"]), []
        for n, x in enumerate(w):
            told += [] if n % 10 == 4 else [r.choice(["rather", "also", "perhaps"])] if n % 10 == 9 else [x, "then"] if n % 7 == 0 else [x]
        rows.append((i["item_id"], " ".join(told)))
        # The same sentences about other things: no leak.
        wrong.append((-i["item_id"], " ".join("word" + x[::-1] if len(x) > 5 or x.isdigit() else x for x in w)))
    posts = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id + 100000 AS doc_id", "text")
    got = find_leaks(spark.createDataFrame(rows + wrong, "doc_id long, text string").unionByName(posts), items).where("doc_id < 100000").collect()
    assert len({x["doc_id"] for x in got if x["doc_id"] == x["item_id"]}) >= 0.9 * len(rows)
    assert not [x for x in got if x["doc_id"] < 0]
    assert not [x for x in got if x["doc_id"] > 0 and x["doc_id"] != x["item_id"]]


def test_leaks_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/eval_items.parquet")
    runs = {}
    for r in items.collect():
        w = words_of(r["text"])
        for i in range(len(w) - RUN + 1):
            runs.setdefault(tuple(w[i : i + RUN]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = words_of(r["text"])
        want |= {(r["doc_id"], i) for k in range(len(w) - RUN + 1) for i in runs.get(tuple(w[k : k + RUN]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect() if r["run"] >= RUN} == want


def test_shortages_go_to_siblings_first():
    root = Node("", 1, children=[
        Node("a", 0.5, children=[Node("a1", 1, 10, 1), Node("a2", 1, 100, 1)]),
        Node("b", 0.5, children=[Node("b1", 1, 100, 1)]),
    ])
    allot(root, 100)
    a, b = root.children
    assert [c.budget for c in a.children] == [10, 40] and b.children[0].budget == 50
    allot(root, 200)
    assert [c.budget for c in a.children] == [10, 90] and b.children[0].budget == 100
    allot(root, 1000)
    assert root.budget == 210
    zero = Node("", 1, children=[Node("a", 0, 10, 1), Node("b", 1, 0, 5)])
    allot(zero, 10)
    assert [c.budget for c in zero.children] == [0, 0]


def _targeted(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, domain string")


def test_plan_passes_shortages_to_siblings_before_ancestors(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "en", 900), ("a", "nl", 40), ("b", "en", 400), ("b", "nl", 200), ("c", "en", 1000)], "source string, lang string, n long")
    targets = _targeted(spark, [("a", 0.42, 1, "x"), ("b", 0.30, 9, "x"), ("c", 0.28, 2, "y")])
    total = 2540
    root = plan(leaf_sizes(docs, targets, "source", "n", "lang"), targets, smoothing=0.5)
    got = {(d.name, p.name, s.name): (s.budget, s.wanted) for d, p, s in root.leaves()}
    split = lambda x, y: x**0.5 / (x**0.5 + y**0.5)
    nl = 0.42 * split(40, 900) * total
    assert got["x", "nl", "a"] == (pytest.approx(40), pytest.approx(nl))
    # What a has too little of in Dutch goes to b in Dutch, not to a or b in English nor to c.
    assert got["x", "nl", "b"][0] == pytest.approx(got["x", "nl", "b"][1] + nl - 40)
    assert got["x", "en", "a"][0] == pytest.approx(got["x", "en", "a"][1]) and got["y", "en", "c"][0] == pytest.approx(0.28 * total)
    assert shortfalls(root) == ["a"]
    short = _targeted(spark, [("a", 0.36, 1, "x"), ("b", 0.30, 1, "x"), ("c", 0.34, 2, "y")])
    root = plan(leaf_sizes(docs, short, "source", "n", "lang"), short)
    got = {d.name: d.budget for d in root.children}
    assert got == {"x": pytest.approx(1540), "y": pytest.approx(1000)} and shortfalls(root) == ["b"]
    # Within x, b's lack goes to a's sibling leaves before it leaves x.
    assert sum(s.budget for _, _, s in root.leaves() if s.name == "a") == pytest.approx(940)
    monkeypatch.setattr(mixture, "allot", lambda *_: None)
    assert shortfalls(plan(leaf_sizes(docs, short, "source", "n", "lang"), short)) == ["a", "b", "c"]


def test_shares_need_not_sum_to_one(spark):
    docs = spark.createDataFrame([("a", "en", 100), ("b", "en", 100)], "source string, lang string, n long")
    for share in (0.4, 0.5, 0.8):
        targets = _targeted(spark, [("a", share, 2, "x"), ("b", share, 1, None)])
        assert shortfalls(plan(leaf_sizes(docs, targets, "source", "n", "lang"), targets)) == (["b"] if share > 0.5 else [])


MIX_DOCS = "doc_id long, source string, n long, size int, part string"


def _mix(spark):
    docs = [(i, " Big " if i % 2 else "BIG", 10, 1, "x") for i in range(300)] + [(1000 + i, "small", 10, 1, "x") for i in range(10)] + [(2000, None, 99, 1, ""), (2001, "other", 99, 1, ""), (2002, "small", None, 1, ""), (2003, "small", -5, 1, "")]
    targets = [("big", 0.5, 1), ("Small", 0.3, 3), ("absent", 0.2, 2)]
    return spark.createDataFrame(docs, MIX_DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mixture(spark):
    docs, targets = _mix(spark)
    sized = leaf_sizes(docs, targets, "source", "n")
    root = plan(sized, targets)
    assert shortfalls(root) == ["absent", "small"]
    chosen = select(sized.select("source", "part", "size", "doc_id"), root, "doc_id").collect()
    big = [r for r in chosen if r["source"] == "big"]
    assert all(r["times"] == 1 for r in big) and sum(r["size"] for r in big) == 2800
    small = [r for r in chosen if r["source"] == "small" and r["size"]]
    assert [r["times"] for r in small] == [3] * 10
    got = {r["source"]: r for r in mixture_report(docs, targets, "source", "n", "doc_id").collect()}
    assert sum(r["reached_share"] for r in got.values()) == pytest.approx(1)
    assert got["absent"]["taken"] == 0 and got["small"]["most_repeats"] == 3 and not got["big"]["falls_short"]
    again = select(sized.select("source", "part", "size", "doc_id").repartition(7), root, "doc_id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))
    other = select(sized.select("source", "part", "size", "doc_id"), root, "doc_id", seed=1).collect()
    assert {r["doc_id"] for r in other} != {r["doc_id"] for r in chosen}


def test_mixture_of_nothing(spark):
    docs, targets = _mix(spark)
    assert mixture_report(docs, targets.limit(0), "source", "n", "doc_id").count() == 0
    empty = mixture_report(docs.limit(0), targets, "source", "n", "doc_id").collect()
    assert {r["reached_share"] for r in empty} == {0.0}


def test_sentences():
    text = '[quote="a1"]One two. Three\nfour[/quote]\n```\ncode here\n```\nname_1:\n> five six\n> seven 99 @who\neight <b>nine</b>&nbsp;te​n'
    assert sentences_of(text) == [["one", "two"], ["three"], ["four"], ["five", "six", "seven"], ["eight", "nine", "ten"]]
    assert sentences_of(None) == sentences_of("") == sentences_of("12 ``` x") == []


def test_long_tags_and_long_words():
    assert sentences_of(f'One <a href="{"x/" * 400}">two</a> three [url={"y" * 300}]four[/url] <img src="{"z" * 300}"> five') == [["one", "two", "three", "four"], ["five"]]
    a, b = "q" * 45 + "ung", "q" * 45 + "tion"
    assert sorted(language.ngram_places(a)) != sorted(language.ngram_places(b))
    m = language.Decoder(["a", "b"], language.codewords(2), np.random.default_rng(1).normal(size=(language.BUCKETS, language.BITS)), np.full(language.BITS, 1 / language.BITS))
    for word in ("abc", "abc" * 3000):
        assert np.allclose(m.word_margins([word])[0], m.weights[language.ngram_places(word)].mean(0))


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{FOLDER}/lang_samples.parquet"))


def test_held_out_sentences(spark):
    samples = spark.read.parquet(f"{FOLDER}/lang_samples.parquet")
    fitted = fit(samples.where("sample_id % 3 <> 0"))
    rest = samples.where("sample_id % 3 = 0").selectExpr("sample_id", "lang AS given", "text")
    got = label_documents(label_parts(rest, fitted, "sample_id", "text"), "sample_id").join(rest, "sample_id")
    assert got.where("lang = given").agg(F.sum("words")).first()[0] >= 0.9 * got.agg(F.sum("words")).first()[0]


def test_codewords_are_far_apart():
    code = language.codewords(7)
    assert min((code[a] != code[b]).sum() for a in range(7) for b in range(a)) >= 10


def test_mixed_documents(spark, model):
    de, en = "Der neue Filter zeigt nur die kurzen Stücke nach der letzten Änderung.", "The new filter only shows the short reads after the last update."
    rows = [(1, f"> {de}\n> {de}\n\n{en}", "x"), (2, en, None), (3, None, "x"), (4, "", "x"), (5, "123 ...", "x"), (None, de, "x"), (7, (en + " ") * 3000, "x"), (2, en, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS words")
    parts = label_parts(df, model, "doc_id", "text").collect()
    assert [(r["part_no"], r["lang"]) for r in sorted((r for r in parts if r["doc_id"] == 1), key=lambda r: r["part_no"])] == [(0, "de"), (1, "en")]
    assert [r["lang"] for r in parts if r["doc_id"] is None] == ["de"]
    assert len([r for r in parts if r["doc_id"] == 2]) == 2
    assert {r["doc_id"] for r in parts} == {1, 2, 7, None}
    assert next(r["words"] for r in parts if r["doc_id"] == 7) == 3000 * len(en.split())
    assert all(0 < r["confidence"] <= 1 for r in parts)
    assert label_parts(df.limit(0), model, "doc_id", "text").count() == 0
