"""Evaluation texts in a corpus, found by latent semantic retrieval.

Documents and items are cut into overlapping windows of words. The TF-IDF matrix of all windows, over the words of the
items (others cannot occur in an item's passage), gets a randomised singular value decomposition: its products are sums
over the partitions, and only matrices of the items' vocabulary come to the driver. Windows of documents whose latent
vectors have a high cosine with a window of an item are candidates. They are then checked in the whole text: longest run of
words in common, longest common subsequence, and whether the item's answer is there.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbin.runtime import spread, stage, unstage

#: Words of a passage that must agree; words between the starts of a document's windows; words of a window. Any run of RUN
#: words contains a whole window of the document, and as items have a window at every word, one of the same words: their
#: cosine is 1 whatever the weights are.
RUN, STRIDE = 13, 4
WINDOW = RUN - STRIDE + 1
RANK, EXTRA = 64, 16
#: Cosine in the latent space from which a window is a candidate.
LEAST_COSINE = 0.7
#: Cosines that a task holds at once; windows whose vectors are formed at once.
CELLS, BLOCK = 2_500_000, 16_384
#: Items are compared in slices of so many, which bounds what is broadcast; vocabulary and latent space are those of all.
ITEMS_AT_ONCE = 5_000
#: Distinct words that all items may have; an evaluation set of more is refused.
MOST_WORDS = 200_000
#: Share of an item's words, in order, that a paraphrase has, and of the weight of the words that are the item's own.
PARAPHRASE = 0.6
#: A word is an item's own if no more than this share of the items has it; of fewer than so many, the rarest are taken.
OWN_SHARE, OWN_WORDS = 0.01, 3

_TAG = re.compile(r"<[^<>\n]*>|\[/?[A-Za-z]+(?:=[^\[\]\n]*)?\]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits without case, accents, markup, entities and invisible characters."""
    if not text:
        return []
    text = html.unescape(text)
    text = _TAG.sub(" ", text)
    text = unicodedata.normalize("NFKD", text.casefold())
    if not text.isascii():
        text = "".join(c for c in text if c < "\x80" or unicodedata.category(c) not in ("Mn", "Cf"))
    return _WORD.findall(text)


def _bounds(sizes: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every window in the joined words of texts of these sizes, and the text of each.

    A text of up to WINDOW words is one window.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    offset = np.cumsum(sizes) - sizes
    count = np.where(sizes > 0, np.maximum(sizes - WINDOW, 0) // stride + 1, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * stride
    end = np.minimum(start + WINDOW, sizes[text])
    return start + offset[text], end + offset[text], text


def _window_sums(words: np.ndarray, start: np.ndarray, end: np.ndarray, factors: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of the windows times ``factors``. Word number -1 is outside the vocabulary."""
    weight = np.where(words >= 0, idf[words], 0.0)
    upto = np.zeros((len(words) + 1, factors.shape[1]))
    np.cumsum(weight[:, None] * factors[words], axis=0, out=upto[1:])
    norm = np.concatenate([[0.0], np.cumsum(weight**2)])
    norm = np.sqrt(np.maximum(norm[end] - norm[start], 1e-12))
    return (upto[end] - upto[start]) / norm[:, None]


def _known_share(words: np.ndarray, start: np.ndarray, end: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length of each window's vector within the vocabulary, as a share of its whole length.

    A cosine with an item's window cannot be larger. Words outside the vocabulary weigh as the mean word in it.
    """
    square = np.concatenate([[0.0], np.cumsum(np.where(words >= 0, idf[words] ** 2, 0.0))])
    other = np.concatenate([[0], np.cumsum(words < 0)])
    inside = square[end] - square[start]
    return np.sqrt(inside / np.maximum(inside + (other[end] - other[start]) * idf.mean() ** 2, 1e-12))


def _unpack(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows, joined words and sizes of whole texts, up to about 50 000 words at once; a longer text is alone."""
    sizes = np.array([len(x) // 4 for x in b["words"]], dtype=np.int64)
    group = np.cumsum(sizes) // 50_000
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        yield b.iloc[at], np.frombuffer(b"".join(b["words"].iloc[at]), dtype=np.int32), sizes[at]


def _blocks(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Windows in blocks of BLOCK and the words they cover, so that a long text needs no more memory than others."""
    for a in range(0, len(start), BLOCK):
        e = min(a + BLOCK, len(start))
        yield slice(a, e), slice(int(start[a]), int(end[e - 1]))


def _summed(texts: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(words, start, end)``, a matrix of that shape, over the windows of all texts.

    A partition sends only rows that are not zero, so what is shuffled follows the words it has seen; rows are added in two
    levels.
    """
    rows, width = shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            for _, words, sizes in _unpack(b):
                start, end, _ = _bounds(sizes)
                for w, p in _blocks(start, end):
                    total += part(words[p], start[w] - p.start, end[w] - p.start)
        seen = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        for piece in np.unique(seen // 1024):
            own = seen[seen // 1024 == piece]
            yield pd.DataFrame({"piece": [piece], "at": [own.tobytes()], "m": [total[own].tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = int(pdf["piece"].iloc[0])
        total = np.zeros((min(1024, rows - piece * 1024), width))
        for at, m in zip(pdf["at"], pdf["m"]):
            total[np.frombuffer(at, dtype=np.int32) - piece * 1024] += np.frombuffer(m, dtype=np.float64).reshape(-1, width)
        every = np.arange(len(total), dtype=np.int32) + piece * 1024
        return pd.DataFrame({"piece": [piece], "at": [every.tobytes()], "m": [total.tobytes()]})

    kind = "piece int, at binary, m binary"
    parts = texts.select("words").mapInPandas(run, kind).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64)))
    done = parts.groupBy("piece", "lane").applyInPandas(add, kind).groupBy("piece").applyInPandas(add, kind).toPandas()
    total = np.zeros(shape)
    for at, m in zip(done["at"], done["m"]):
        total[np.frombuffer(at, dtype=np.int32)] = np.frombuffer(m, dtype=np.float64).reshape(-1, width)
    return total


@dataclass
class Latent:
    """``factors``: the latent vector of each word of the vocabulary."""

    idf: np.ndarray
    factors: np.ndarray


def latent_space(texts: DataFrame, n: int, seed: int = 11) -> Latent:
    """IDF over all windows of ``texts`` (column ``words``: packed word numbers below n) and the randomised SVD."""

    def document_frequency(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        i = np.repeat(np.arange(len(start)), end - start)
        p = np.arange(len(i)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + start[i]
        w = words[p]
        pairs = np.unique(i[w >= 0] * np.int64(n) + w[w >= 0])
        df = np.bincount(pairs % n, minlength=n + 1).astype(float)
        df[n] = len(start)
        return df[:, None]

    df = _summed(texts, (n + 1, 1), document_frequency)[:, 0]
    idf = np.log1p(df[n] / np.maximum(df[:n], 1.0))
    width = min(RANK + EXTRA, n)
    omega = np.random.default_rng(seed).standard_normal((n, width))

    def gram(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        y = _window_sums(words, start, end, omega, idf)
        return y.T @ y

    g = _summed(texts, (width, width), gram)
    value, vector = np.linalg.eigh(g)
    keep = value > value.max() * 1e-10
    basis = omega @ (vector[:, keep] / np.sqrt(value[keep]))  # A @ basis has orthonormal columns

    def project(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A' (A basis): each word gets the sum of the windows it is in."""
        weight = np.where(words >= 0, idf[words], 0.0)
        square = np.concatenate([[0.0], np.cumsum(weight**2)])
        q = _window_sums(words, start, end, basis, idf) / np.sqrt(np.maximum(square[end] - square[start], 1e-12))[:, None]
        change = np.zeros((len(words) + 1, q.shape[1]))
        change[start] = q
        last = np.flatnonzero(np.r_[True, np.diff(end) != 0])
        change[end[last]] -= np.add.reduceat(q, last, axis=0)
        at_word = np.cumsum(change[:-1], axis=0) * weight[:, None]
        known = np.flatnonzero(words >= 0)
        out = np.zeros((n, q.shape[1]))
        if len(known):
            order = known[np.argsort(words[known], kind="stable")]
            edge = np.flatnonzero(np.r_[True, np.diff(words[order]) != 0])
            out[words[order[edge]]] = np.add.reduceat(at_word[order], edge, axis=0)
        return out

    bt = _summed(texts, (n, basis.shape[1]), project)
    u, _, _ = np.linalg.svd(bt, full_matrices=False)
    return Latent(idf, u[:, :RANK])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]).astype(np.float32)


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the longest passage that both have; word number -1 agrees with none."""
    best, row = 0, np.zeros(len(b) + 1, dtype=np.int64)
    for w in a:
        row[1:] = np.where((b == w) & (w >= 0), row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit per word of b."""
    masks: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a.tolist():
        m = masks.get(w, 0) if w >= 0 else 0
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def passages(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of RUN known words of one text, and the text of each."""
    if len(words) < RUN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(words, RUN)
    good = (at >= 0).all(1) & (owner[: len(at)] == owner[RUN - 1 :])
    factor = np.random.default_rng(5).integers(1, 2**63, RUN, dtype=np.uint64) * 2 + 1
    return (at[good].astype(np.uint64) * factor).sum(1, dtype=np.uint64), owner[: len(at)][good]


def _numbered(df: DataFrame, ident: str, columns: list[str], vocabulary: dict[str, int]) -> DataFrame:
    """``ident`` and, for each text column, its words' packed numbers (-1: not in the vocabulary)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            packed = {c: [np.array([known.get(w, -1) for w in words_of(t)], dtype=np.int32).tobytes() for t in b[c]] for c in columns}
            yield pd.DataFrame({ident: b[ident], **packed})

    kinds = ", ".join(f"{c} binary" for c in columns)
    return df.mapInPandas(run, f"{ident} long, {kinds}")


def _item_words(items: DataFrame) -> pd.DataFrame:
    """``word, items``: every word of the items and how many of them have it, in the order of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [set(words_of(t)) for t in b["text"]]
            told = [set(words_of(t)) - o for t, o in zip(b["answer"], own)]
            words = [w for s in own for w in s]
            more = [w for s in told for w in s]
            yield pd.DataFrame({"word": pd.Series(words + more, dtype=object), "n": [1] * len(words) + [0] * len(more)})

    counted = items.select("text", "answer").mapInPandas(run, "word string, n int").groupBy("word").agg(F.sum("n").alias("items"))
    found = counted.orderBy("word").limit(MOST_WORDS + 1).toPandas()
    if len(found) > MOST_WORDS:
        raise ValueError(f"the items have more than {MOST_WORDS} distinct words")
    return found


def find_leaks(docs: DataFrame, items: DataFrame, least_cosine: float = LEAST_COSINE, answer: str | None = None) -> DataFrame:
    """Leaked passages: ``doc_id, item_id, cosine, run, in_order, answered``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``. Candidates are pairs with windows whose latent vectors
    have a cosine of at least ``least_cosine`` (``cosine`` is the best). They come out if they have a passage of at least
    ``RUN`` words in common (``run``: the longest), or if the document has the item's answer (``answered``) and at least
    ``PARAPHRASE`` of the item's words in the same order (``in_order``), both near one and the same candidate window;
    ``run`` is 0 then. All candidate windows of a pair are checked. ``answer`` names a column of the items: all its words
    must be there. Without it, or where it is empty, the answer is what sets the item apart: the words that hardly any other
    item has, of which ``PARAPHRASE`` must be there by weight.

    Null and empty texts have no words and are in no pair; a pair comes once, however often a document's rows are repeated;
    other columns are not read. Whole texts are read and judged as one. Windows of which too much is outside the items'
    vocabulary for that cosine are left out; every other is compared with every window of every item.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, run int, in_order double, answered boolean"
    told = F.col(f"`{answer}`").cast("string") if answer else F.lit("")
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.coalesce(told, F.lit("")).alias("answer")).where("text is not null and item_id is not null")
    known = _item_words(listed)
    if not len(known):
        return spark.createDataFrame([], schema)
    vocabulary = {w: i for i, w in enumerate(known["word"])}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    numbered = stage(_numbered(spread(texts), "doc_id", ["text"], vocabulary).withColumnRenamed("text", "words"), "leak-words")
    asked = stage(_numbered(listed, "item_id", ["text", "answer"], vocabulary).withColumnRenamed("text", "words"), "leak-items")
    space = latent_space(numbered.select("words").unionByName(asked.select("words")), len(vocabulary))
    own = known["items"].to_numpy() <= max(1.0, OWN_SHARE * asked.count())
    found: list[DataFrame] = []
    for rows in batched(asked.orderBy("item_id", "words").toLocalIterator(), ITEMS_AT_ONCE):
        found.append(stage(_search(numbered, rows, space, own, least_cosine, schema), "leaks"))
    unstage(numbered)
    unstage(asked)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "run", "in_order", "answered")])


def _answer(words: np.ndarray, told: np.ndarray, own: np.ndarray, idf: np.ndarray) -> tuple[dict[int, float], float]:
    """Words that are an item's answer with their weights, and the weight that must be found."""
    if len(told):
        return dict.fromkeys(told.tolist(), 1.0), float(len(set(told.tolist())))
    rare = sorted(set(words.tolist()), key=lambda i: (not own[i], -idf[i], i))
    count = max(OWN_WORDS, int(own[rare].sum()))
    weights = {i: float(idf[i]) for i in rare[:count]}
    return weights, PARAPHRASE * sum(weights.values())


def _search(numbered: DataFrame, rows: tuple, space: Latent, own: np.ndarray, least_cosine: float, schema: str) -> DataFrame:
    """The leaks of one slice of items in all documents."""
    ids = [r["item_id"] for r in rows]
    texts = [np.frombuffer(r["words"], dtype=np.int32) for r in rows]
    sizes = np.array([len(w) for w in texts])
    joined = np.concatenate(texts)
    start, end, item_of = _bounds(sizes, 1)
    latent = _unit(_window_sums(joined, start, end, space.factors, space.idf))
    answers = [_answer(w, np.frombuffer(r["answer"], dtype=np.int32), own, space.idf) if len(w) else ({}, 0.0) for w, r in zip(texts, rows)]
    codes, code_item = passages(joined, np.repeat(np.arange(len(sizes)), sizes))
    by_code: dict[int, set[int]] = {}
    for c, i in zip(codes.tolist(), code_item.tolist()):
        by_code.setdefault(c, set()).add(i)
    shared = numbered.sparkSession.sparkContext.broadcast((space, latent, item_of, ids, texts, answers, by_code))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, latent, item_of, ids, texts, answers, by_code = shared.value
        all_codes, step = np.array(sorted(by_code), dtype=np.uint64), max(16, CELLS // max(len(latent), 1))

        def candidates(words: np.ndarray, sizes: np.ndarray) -> dict[tuple[int, int], tuple[float, list[tuple[int, int]]]]:
            """For pairs of document and item the best cosine and the bounds of all candidate windows."""
            out: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {}
            start, end, doc = _bounds(sizes)
            for block, p in _blocks(start, end):
                s, e, d = start[block] - p.start, end[block] - p.start, doc[block]
                keep = _known_share(words[p], s, e, space.idf) >= least_cosine
                s, e, d = s[keep], e[keep], d[keep]
                mine = _unit(_window_sums(words[p], s, e, space.factors, space.idf))
                for a in range(0, len(s), step):
                    cosine = mine[a : a + step] @ latent.T
                    w, i = np.nonzero(cosine >= least_cosine)
                    for at, it, c in zip((a + w).tolist(), item_of[i].tolist(), cosine[w, i].tolist()):
                        pair, place = (int(d[at]), it), (int(s[at]) + p.start, int(e[at]) + p.start)
                        top, places = out.get(pair, (-1.0, []))
                        if not places or places[-1] != place:
                            places.append(place)
                        out[pair] = (max(top, c), places)
            return out

        for b in batches:
            for part, words, sizes in _unpack(b):
                offset = np.cumsum(sizes) - sizes
                # The exact check of the candidates.
                code, owner = passages(words, np.repeat(np.arange(len(sizes)), sizes))
                shown = np.isin(code, all_codes)
                alike: dict[int, set[int]] = {}
                for c, d in zip(code[shown].tolist(), owner[shown].tolist()):
                    alike.setdefault(d, set()).update(by_code[c])
                found, has = [], {}
                for (d, it), (c, places) in candidates(words, sizes).items():
                    text, verbatim, (weights, needed) = texts[it], it in alike.get(d, ()), answers[it]
                    whole = words[offset[d] : offset[d] + sizes[d]]
                    if d not in has:
                        has[d] = set(whole.tolist())
                    possible = sum(v for w, v in weights.items() if w in has[d]) >= needed
                    if not verbatim and not possible:
                        continue
                    answered, in_order = False, 0.0
                    for s, e in places:
                        near = words[max(offset[d], s - len(text)) : min(offset[d] + sizes[d], e + len(text))]
                        there = set(near.tolist()) if possible else ()
                        here = possible and sum(v for w, v in weights.items() if w in there) >= needed
                        if here or (verbatim and not answered):
                            answered, in_order = max((answered, in_order), (here, common_subsequence(near, text) / len(text)))
                    if not verbatim and not answered:
                        continue
                    run_length = longest_run(text, whole) if verbatim else 0
                    if run_length >= RUN or (answered and in_order >= PARAPHRASE):
                        found.append((part["doc_id"].iloc[d], ids[it], c, run_length, in_order, answered))
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "cosine", "run", "in_order", "answered"])

    return numbered.mapInPandas(run, schema)
