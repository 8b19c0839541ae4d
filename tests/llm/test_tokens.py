from strandbin.llm.mixture import token_counts
from strandbin.llm.queries import TOKENIZER


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world", 1), ("", 2), (None, 3), ("<|endoftext|>", 4)], "text string, tokens int")
    got = [r["tokens"] for r in token_counts(df, "text", TOKENIZER).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1
