import random

from strandbin.llm import topn
from strandbin.llm.topn import top_n_per_group


def _want(rows, n):
    best = {}
    for g, h, s, i in rows:
        if s is not None and s == s and i is not None:
            best.setdefault((g, h), {})
            best[g, h][i] = max(s, best[g, h].get(i, s))
    return {(g, h, i, s + 0.0) for (g, h), items in best.items() for i, s in sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n]}


def _got(spark, rows, n, **more):
    df = spark.createDataFrame(rows, "g string, h string, score double, no long").selectExpr("*", "'x' AS s", "1 AS lo", "2 AS g0").repartition(3)
    return {(r["g"], r["h"], r["no"], r["score"] + 0.0) for r in top_n_per_group(df, ["g", "h"], "score", "no", n, **more).collect()}


def test_random_scores_and_ties(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.5 else r.choice("abc"), r.choice(["x", None]), r.choice([None, float("nan"), -0.0, 0.0, 1.5, -2.0, round(r.uniform(-9, 9), 2)]), r.randrange(-500, 4000)) for _ in range(3000)]
    assert _got(spark, rows, 3) == _want(rows, 3)
    assert _got(spark, rows, 40, ways=4) == _want(rows, 40)


def test_extremes(spark):
    scores = [float("inf"), float("-inf"), 1e308, -1e308, 5e-324, -5e-324, 0.0]
    rows = [("a", "b", s, i) for i, s in enumerate(scores * 3)] + [("a", "b", 7.0, 2**63 - 1), ("a", "b", 7.0, -(2**63))]
    for n in (1, 2, 4, 9, 22):
        assert _got(spark, rows, n) == _want(rows, n)


def test_all_equal_and_salts(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROWS_PER_SALT", 100)
    rows = [("a", "b", 1.0, i) for i in range(1000)]
    assert _got(spark, rows, 5, unique=True) == {("a", "b", i, 1.0) for i in range(5)}


def test_salted_groups_with_nulls(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROWS_PER_SALT", 50)
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", None, "b"]), r.choice(["x", None]), r.choice([1.0, 2.0, round(r.uniform(-9, 9), 1)]), i) for i in range(1500)]
    for n in (1, 7, 120):
        assert _got(spark, rows, n) == _want(rows, n)
    monkeypatch.setattr(topn, "MOST_HOT", 2)  # more rows a salt, so that fewer groups have several
    assert _got(spark, rows, 7) == _want(rows, 7)


def test_empty(spark):
    assert _got(spark, [("a", "b", None, 1)], 3) == set()
    df = spark.createDataFrame([], "g string, score double, no long")
    assert top_n_per_group(df, ["g"], "score", "no", 3).count() == 0
