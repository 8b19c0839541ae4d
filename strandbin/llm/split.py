"""Cut long texts into pieces under a limit, at natural boundaries where there are any, with a given overlap.

One regular expression does the cutting, in the JVM: from the end of the last match it takes the rest if that fits, else as
many characters as the limit allows that end at the strongest kind of boundary, else at the next kind, else the limit
itself. Each later piece begins ``overlap`` characters before the end of the one before it, so its match is that much
shorter; the offsets come from the lengths of the matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A place after ten or more characters that are no base, before one that is.
ASSEMBLY_GAP = r"(?<=[^ACGTacgt]{10})(?![^ACGTacgt])"
#: Paragraphs, then sentences, then words.
PROSE = (r"(?<=\n\n)(?!\n)", r"(?<=[.!?…][\s])", r"(?<=\s)(?=\S)")


def piece_pattern(limit: int, fill: int, overlap: int, boundaries: Sequence[str]) -> str:
    """The expression whose consecutive matches are the parts of a text that its pieces add.

    A piece ends at the last boundary that leaves it ``fill`` to ``limit`` characters.
    """
    if not 0 <= overlap < fill <= limit:
        raise ValueError("0 <= overlap < fill <= limit must hold")

    def alternatives(least: int, most: int) -> str:
        return "|".join([rf".{{1,{most}}}\z", *[f".{{{least},{most}}}{b}" for b in boundaries], f".{{{most}}}"])

    return rf"(?s)\A(?:{alternatives(fill, limit)})|(?!\A)\G(?:{alternatives(fill - overlap, limit - overlap)})"


def piece_lengths(text: Column, limit: int, fill: int, overlap: int, boundaries: Sequence[str]) -> Column:
    """How many characters each piece adds to those before it."""
    return F.transform(F.regexp_extract_all(text, F.lit(piece_pattern(limit, fill, overlap, boundaries)), F.lit(0)), lambda m: F.length(m))


def split_oversized(df: DataFrame, key: str, text: str, limit: int, fill: int, overlap: int, boundaries: Sequence[str]) -> DataFrame:
    """Pieces of every text longer than ``limit``: ``key, piece_no, start_pos, end_pos`` (half-open, from 0).

    A key that comes several times is cut once; if its texts differ, the longest counts. Null texts, empty texts and texts
    up to the limit have no pieces, a null key is a key. Characters are Unicode code points. Texts never leave the scan:
    only lengths are shuffled. Other columns are not read.
    """
    long_ones = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.length("text") > limit)
    cut = long_ones.select("key", F.length("text").alias("size"), piece_lengths(F.col("text"), limit, fill, overlap, boundaries).alias("parts"))
    once = cut.groupBy("key").agg(F.max(F.struct("size", "parts")).alias("best"))
    parts = once.select("key", F.posexplode("best.parts").alias("piece_no", "part"))
    upto = F.sum("part").over(Window.partitionBy("key").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, 0))
    ends = parts.select("key", "piece_no", "part", upto.cast("int").alias("end_pos"))
    start = F.when(F.col("piece_no") == 0, 0).otherwise(F.col("end_pos") - F.col("part") - overlap).cast("int")
    return ends.select(F.col("key").alias(key), "piece_no", start.alias("start_pos"), "end_pos")


def cut_texts(df: DataFrame, text: str, limit: int, fill: int, overlap: int, boundaries: Sequence[str]) -> DataFrame:
    """``df`` with the array column ``pieces``, the texts of the pieces; a text up to the limit is its only piece.

    Null stays null and an empty text gives an empty array. A column ``pieces`` of ``df`` is replaced.
    """
    cols = [F.col(f"`{c}`") for c in df.columns if c != "pieces"]
    t = F.col(f"`{text}`")
    sized = df.select(*cols, piece_lengths(t, limit, fill, overlap, boundaries).alias("pieces"))
    # One pass over the lengths: the pieces so far and where the last of them ends.
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("end"))

    def add(acc: Column, part: Column) -> Column:
        back = F.when(acc["end"] > 0, overlap).otherwise(0)
        return F.struct(F.concat(acc["pieces"], F.array(F.substring(t, acc["end"] - back + 1, part + back))).alias("pieces"), (acc["end"] + part).alias("end"))

    cut = F.aggregate("pieces", start, add, lambda acc: acc["pieces"])
    return sized.select(*cols, F.when(t == "", F.array().cast("array<string>")).otherwise(cut).alias("pieces"))
