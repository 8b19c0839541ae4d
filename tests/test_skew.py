import random
from itertools import groupby

from strandbin.operators.skew import heavy_keys, number_rows, split_key_summary

SCHEMA = "k string, v long, row_count int, pid int"


def _rows(n, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.6 else r.choice(["a", "b", "c", None, ""]), r.choice([None, *range(40)]), 1, 2) for _ in range(n)]


def test_summary_equals_plain_grouping(spark):
    rows = _rows(3000)
    got = {r["key"]: r for r in split_key_summary(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", "v", partitions=9).collect()}
    assert set(got) == {k for k, *_ in rows if k is not None}
    for key, r in got.items():
        own = [v for k, v, *_ in rows if k == key]
        values = sorted(v for v in own if v is not None)
        assert (r["row_count"], r["distinct_values"], r["first_value"], r["last_value"]) == (len(own), len(set(values)), values[0], values[-1])
        assert r["max_step"] == max(b - a for a, b in zip(values, values[1:]))
    assert got["hot"]["pieces"] > 1


def test_one_repeated_row_is_cut(spark):
    df = spark.range(5000).selectExpr("'x' AS k", "7L AS v").repartition(4)
    r = split_key_summary(df, "k", "v", partitions=8).first()
    assert (r["row_count"], r["distinct_values"], r["max_step"]) == (5000, 1, 0.0) and r["pieces"] > 4


def test_strings_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "y"), (None, "z"), ("b", None)], "k string, v string")
    got = {r["key"]: r.asDict() for r in split_key_summary(df, "k", "v").collect()}
    assert got["a"]["distinct_values"] == 2 and got["a"]["last_value"] == "y" and got["a"]["max_step"] is None
    assert got["b"]["row_count"] == 1 and got["b"]["first_value"] is None
    assert split_key_summary(df.limit(0), "k", "v").count() == 0


def test_nan_counts_as_row_only(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 3.0)], "k string, v double")
    r = split_key_summary(df, "k", "v").first()
    assert (r["row_count"], r["distinct_values"], r["max_step"]) == (3, 2, 2.0)


def test_heavy_keys_count_null_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [(None, i) for i in range(97)], "k string, v long")
    assert [r["key"] for r in heavy_keys(df, "k", "v").collect()] == ["a"]
    assert heavy_keys(df.union(df.where("k is null")), "k", "v").count() == 0


def test_numbers(spark):
    rows = [(k, v, i) for i, (k, v, *_) in enumerate(_rows(2000))]
    got = number_rows(spark.createDataFrame(rows, "k string, v long, row_no int").withColumnRenamed("row_no", "id"), "k", ["v", "id"], partitions=7).collect()
    want = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))
    numbers = {r[2]: i for _, g in groupby(want, key=lambda r: r[0]) for i, r in enumerate(g)}
    assert {r["id"]: r["row_no"] for r in got} == numbers
