import random
import re

from strandbin.llm.split import ASSEMBLY_GAP, PROSE, cut_texts, split_oversized


def _want(seq, limit, fill, overlap):
    gap_ends = [m.end() for m in re.finditer("[^ACGTacgt]{10,}", seq)]
    out, s = [], 0
    while True:
        if len(seq) - s <= limit:
            out.append((len(out), s, len(seq)))
            return out
        e = max([g for g in gap_ends if s + fill <= g <= s + limit], default=s + limit)
        out.append((len(out), s, e))
        s = e - overlap


def _sequence(r, n):
    out = []
    while sum(map(len, out)) < n:
        out.append("".join(r.choices("ACGTacgt", k=r.randrange(1, 90))) + r.choice(["", "N", "N" * 9, "n" * 10, "-N" * 8]))
    return "".join(out)[:n]


def test_equals_the_rule(spark):
    r = random.Random(2)
    seqs = {f"c{i}": _sequence(r, n) for i, n in enumerate([99, 100, 101, 190, 191, 500, 5000, 20_000])}
    seqs["all gap"] = "N" * 450
    rows = [(k, s, 1, 2) for k, s in seqs.items()] + [("c5", seqs["c5"], 1, 2), ("null", None, 1, 2), ("", "", 1, 2), (None, seqs["c5"], 1, 2)]
    df = spark.createDataFrame(rows, "contig string, seq string, piece_no int, key int")
    got = {}
    for x in split_oversized(df, "contig", "seq", 100, 50, 10, [ASSEMBLY_GAP]).collect():
        got.setdefault(x["contig"], []).append((x["piece_no"], x["start_pos"], x["end_pos"]))
    want = {k: _want(s, 100, 50, 10) for k, s in seqs.items() if len(s) > 100} | {None: _want(seqs["c5"], 100, 50, 10)}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_very_long_text(spark):
    df = spark.range(1).selectExpr("id", "repeat('ACGTACGTAC', 400000) AS seq")
    rows = split_oversized(df, "id", "seq", 10_000, 5_000, 200, [ASSEMBLY_GAP]).orderBy("piece_no").collect()
    assert [(x["start_pos"], x["end_pos"]) for x in rows] == [(a, e) for _, a, e in _want("A" * 4_000_000, 10_000, 5_000, 200)]


def test_prose_prefers_strong_boundaries(spark):
    text = "One two three. Four five six seven.\n\nEight nine ten eleven twelve. Thirteen 🙂 fourteen fifteen sixteen."
    df = spark.createDataFrame([(text,), ("",), (None,), ("short",)], "text string")
    got = [r["pieces"] for r in cut_texts(df, "text", 50, 20, 5, PROSE).collect()]
    assert got[1:] == [[], None, ["short"]]
    assert got[0][0].endswith("\n\n") and all(len(p) <= 50 for p in got[0])
    assert got[0][0] + "".join(p[5:] for p in got[0][1:]) == text
    assert all(b.startswith(a[-5:]) for a, b in zip(got[0], got[0][1:]))


def test_empty(spark):
    assert split_oversized(spark.createDataFrame([], "k string, t string"), "k", "t", 100, 50, 10, PROSE).count() == 0
