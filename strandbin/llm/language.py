"""Languages of documents and of their parts, by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over character n-grams says which half of the
languages a text belongs to. A text gets the language whose codeword its bits fit best, each bit's logistic loss weighted
by how well its classifier does; close second codewords make the decision ambiguous. The classifiers are linear in words,
so a word is scored once and a sentence is the mean of its words.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbin.runtime import spread

#: Documents whose sentences, where label and first classifier agree, extend the labelled samples. A documented bound.
TRAINING_DOCUMENTS = 1_000
TRAINING_SENTENCES = 2_500
#: Labelled samples that the classifiers are fitted on, at most, by hash order. A documented bound.
TRAINING_SAMPLES = 20_000
BITS = 31
BUCKETS = 4096
#: A sentence is ambiguous if the second language is nearer than this to the first (share of the first's probability).
AMBIGUOUS = 0.75
#: Words of one language that make it count in a document.
LEAST_WORDS = 20

_CODE = re.compile(r"```.*?(?:```|\Z)|\[(code|img)\].*?(?:\[/\1\]|\Z)", re.S | re.I)
_INLINE = re.compile(r"</?(?:b|i|em|span|u|strong|a|font)(?:\s[^<>\n]*)?>|\[/?(?:b|i|u|url)(?:=[^\[\]\n]*)?\]", re.I)
_TAG = re.compile(r"<[^<>\n]*>|\[/?[A-Za-z]+(?:=[^\[\]\n]*)?\]")
_QUOTED = re.compile(r"\s*((?:>\s?)+)")
_NAMED = re.compile(r"\s*[\w.@-]+:\s*\Z")
_STOP = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"\S*[\d@#=_]\S*")


def sentences_of(text: str | None) -> list[list[str]]:
    """The words of each sentence, lower-cased; a sentence never spans a quote's edge, a block tag or a line of its own.

    Wrapped lines of one quote are joined. Code, tags, entities, invisible characters, names and numbers are no words.
    """
    if not text:
        return []
    text = html.unescape(html.unescape(text)) if "&" in text else text
    text = _CODE.sub("\n", text)
    text = _TAG.sub("\n", _INLINE.sub("", text))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFC", text) if c < "\x80" or unicodedata.category(c) != "Cf")
    parts: list[str] = []
    depth_before = 0
    for line in text.splitlines():
        m = _QUOTED.match(line)
        depth = m.group(1).count(">") if m else 0
        body = line[m.end() :] if m else line
        if not body.strip() or _NAMED.match(body):
            depth_before = -1
            continue
        if depth and depth == depth_before:
            parts[-1] += " " + body
        else:
            parts.append(body)
        depth_before = depth
    out = []
    for part in parts:
        for sentence in _STOP.split(part):
            words = _WORD.findall(_TOKEN.sub(" ", sentence).lower())
            if words:
                out.append(words)
    return out


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def ngram_places(word: str) -> list[int]:
    """Buckets of the n-grams of 1 to 4 characters of a word with its edges, and of the whole word."""
    w = f"^{word}$"
    grams = [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in [*grams[1:], w, w]]


def codewords(languages: int, bits: int = BITS, seed: int = 3) -> np.ndarray:
    """±1 codewords with a large least distance: the best of many random draws of balanced columns."""
    rng = np.random.default_rng(seed)
    if languages < 2:
        return np.ones((languages, bits))
    best, best_gap = None, -1
    for _ in range(400):
        half = languages // 2
        code = np.stack([rng.permutation(np.r_[np.ones(half), -np.ones(languages - half)]) for _ in range(bits)], axis=1)
        gap = min(int((code[a] != code[b]).sum()) for a in range(languages) for b in range(a))
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class Decoder:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    sharpness: float = 1.0

    def word_margins(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.code.shape[1]))
        for i, w in enumerate(words):
            at = ngram_places(w)
            # The mean over the places; a word of more n-grams than buckets is counted first.
            out[i] = self.weights[at].mean(0) if len(at) < BUCKETS else np.bincount(at, minlength=BUCKETS) @ self.weights / len(at)
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """From mean margins of texts: loss-weighted decoding, as probabilities over the languages."""
        loss = np.stack([(np.logaddexp(0.0, -margins * c) * self.trust).sum(1) for c in self.code], axis=1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.sharpness)
        return p / p.sum(1, keepdims=True)


def _features(texts: list[list[str]]) -> np.ndarray:
    x = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    places: dict[str, np.ndarray] = {}
    for i, words in enumerate(texts):
        for w in words:
            if w not in places:
                places[w] = np.array(ngram_places(w))
        at = np.concatenate([places[w] for w in words])
        share = np.concatenate([np.full(len(places[w]), 1.0 / len(places[w])) for w in words])
        x[i] = np.bincount(at, share, BUCKETS) / len(words)
    return x


def _train(x: np.ndarray, label: np.ndarray, code: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all bits at once, by full-batch gradient steps with momentum; classes weigh the same."""
    target = code[label]
    weight = (1.0 / np.bincount(label, minlength=len(code))[label])[:, None]
    weight = weight / weight.sum()
    scale = np.sqrt((x * x).mean(0)) + 1e-3
    xs = (x / scale).astype(np.float32)
    w, v = np.zeros((x.shape[1], code.shape[1]), np.float32), 0.0
    norm = float((xs * xs).sum(1).mean())
    for _ in range(rounds):
        m = xs @ w
        g = xs.T @ (-(target * weight) / (1.0 + np.exp(np.clip(target * m, -30, 30)))).astype(np.float32) + 1e-4 * w / norm
        v = 0.9 * v - (4.0 / norm) * g
        w = w + v
    right = ((xs @ w) * target > 0).astype(float)
    accuracy = np.clip((right * weight).sum(0), 0.51, 0.999)
    trust = np.log(accuracy / (1 - accuracy))
    return (w / scale[:, None]).astype(np.float64), trust / trust.sum()


def _calibrated(model: Decoder, texts: list[list[str]], label: np.ndarray) -> Decoder:
    """Sets the sharpness under which pieces of three words are most likely to have their label."""
    pieces = [(t[i : i + 3], n) for t, n in zip(texts, label) for i in range(0, len(t) - 2, 3)][:4000]
    margins = np.array([model.word_margins(p).mean(0) for p, _ in pieces])
    truth = np.array([n for _, n in pieces])

    def surprise(sharpness: float) -> float:
        model.sharpness = sharpness
        return -float(np.log(np.maximum(model.probabilities(margins)[np.arange(len(truth)), truth], 1e-9)).mean())

    model.sharpness = min((0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=surprise) if len(pieces) else 1.0
    return model


def fit(samples: DataFrame, docs: DataFrame | None = None) -> Decoder:
    """Fits on ``samples`` (``lang, text``; at most ``TRAINING_SAMPLES`` of them), with and without accents.

    With ``docs`` (``text, lang``), a bounded number of their sentences follow (``TRAINING_DOCUMENTS`` by hash order,
    ``TRAINING_SENTENCES``): those to which the classifiers so far give the document's own label, clearly.
    """
    rows = samples.select(F.lower("lang").alias("lang"), "text").where("lang is not null and text is not null").orderBy(F.xxhash64("text"), "lang", "text").limit(TRAINING_SAMPLES).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["text"]))
    languages = sorted({r["lang"] for r in rows})
    texts, label = [], []
    for r in rows:
        words = [w for s in sentences_of(r["text"]) for w in s]
        if words:
            texts += [words, [plain(w) for w in words]]
            label += [languages.index(r["lang"])] * 2
    code = codewords(len(languages))
    weights, trust = _train(_features(texts), np.array(label), code) if texts else (np.zeros((BUCKETS, BITS)), np.full(BITS, 1.0 / BITS))
    model = _calibrated(Decoder(languages, code, weights, trust), texts, np.array(label))
    if docs is None or not texts:
        return model
    named = F.lower(F.substring("lang", 1, 2)).alias("lang")
    some = docs.select("text", named).where(F.col("lang").isin(languages)).orderBy(F.xxhash64("text"), "lang").limit(TRAINING_DOCUMENTS).collect()
    extra = [(s, languages.index(r["lang"])) for r in some for s in sentences_of(r["text"]) if len(s) >= 6][:TRAINING_SENTENCES]
    if not extra:
        return model
    given = np.array([n for _, n in extra])
    p = model.probabilities(np.array([model.word_margins(s).mean(0) for s, _ in extra]))
    sure = (p.argmax(1) == given) & (p.max(1) > 0.6)
    more = [s for (s, _), ok in zip(extra, sure) if ok]
    texts = texts + more + [[plain(w) for w in s] for s in more]
    label = np.r_[label, given[sure], given[sure]].astype(int)
    weights, trust = _train(_features(texts), label, code)
    return _calibrated(Decoder(languages, code, weights, trust), texts, label)


def label_parts(docs: DataFrame, model: Decoder, ident: str, text: str) -> DataFrame:
    """``ident, part_no, lang, words, confidence, ambiguous``: the runs of sentences of one language in each document.

    A sentence of fewer than four words between sentences of one language takes that language. Texts that are null, empty
    or without words have no parts; a null identifier is an identifier; other columns are not read. Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[ident]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        place: dict[str, int] = {}
        scores = np.empty((0, m.code.shape[1]))
        for b in batches:
            if len(place) > 200_000:
                place, scores = {}, scores[:0]
            doc_of, size, flat, new = [], [], [], []
            for i, t in enumerate(b["text"]):
                for s in sentences_of(t):
                    doc_of.append(i)
                    size.append(len(s))
                    for w in s:
                        at = place.get(w)
                        if at is None:
                            at = place[w] = len(place)
                            new.append(w)
                        flat.append(at)
            if not doc_of:
                continue
            if new:
                scores = np.concatenate([scores, m.word_margins(new)])
            doc_of, size = np.array(doc_of), np.array(size)
            start = np.cumsum(size) - size
            p = m.probabilities(np.add.reduceat(scores[flat], start, axis=0) / size[:, None])
            best = p.argmax(1)
            # Short sentences between equal neighbours.
            for i in np.flatnonzero(size < 4):
                before = best[i - 1] if i and doc_of[i - 1] == doc_of[i] else None
                after = best[i + 1] if i + 1 < len(best) and doc_of[i + 1] == doc_of[i] else None
                if before is not None and before == after:
                    best[i] = before
            edge = np.flatnonzero(np.r_[True, (doc_of[1:] != doc_of[:-1]) | (best[1:] != best[:-1])])
            words = np.add.reduceat(size, edge)
            mean = np.add.reduceat(p * size[:, None], edge, axis=0) / words[:, None]
            top = mean[np.arange(len(edge)), best[edge]]
            mean[np.arange(len(edge)), best[edge]] = -1
            first = np.r_[True, doc_of[edge[1:]] != doc_of[edge[:-1]]]
            number = np.arange(len(edge)) - np.maximum.accumulate(np.where(first, np.arange(len(edge)), 0))
            yield pd.DataFrame(
                {
                    "id": b["id"].to_numpy()[doc_of[edge]],
                    "part_no": number.astype(np.int32),
                    "lang": [m.languages[i] for i in best[edge]],
                    "words": words.astype(np.int32),
                    "confidence": top,
                    "ambiguous": mean.max(1) > AMBIGUOUS * np.maximum(top, 1e-12) if len(m.languages) > 1 else np.zeros(len(edge), bool),
                }
            )

    found = spread(docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text"))).mapInPandas(run, f"id {kind}, part_no int, lang string, words int, confidence double, ambiguous boolean")
    return found.withColumnRenamed("id", ident)


def label_documents(parts: DataFrame, ident: str) -> DataFrame:
    """Per document and language: ``ident, lang, words, confidence`` (mean over its words)."""
    sums = parts.groupBy(ident, "lang").agg(F.sum("words").cast("int").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    return sums
