"""Language of documents and of their paragraphs, by nearest centroid.

A paragraph becomes a TF-IDF vector of the character n-grams (1 to 3, inside words,
their ends marked) in a hashed space of ``buckets`` dimensions, normalised to length 1.
Several centroids stand for each language; the nearest by cosine names the paragraph, and
a paragraph too far from it for that centroid's own members is rejected (no language).

The centroids are fitted here, on a bounded sample of labelled documents: up to
``per_label`` of each language, in order of a hash of their ids. Labels may be wrong and
documents mixed, so labels do not shape the clusters: spherical k-means groups the
sample's paragraphs by content alone, and each cluster takes the language for which most
of its members vote, a paragraph's vote counting by how much of its document agrees. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

from .threads import one_thread

LANGUAGES = ["en", "hi", "mr", "bn", "ta", "gu", "ur"]
#: Codes of three letters and English names (fixed values).
NAMES = {"eng": "en", "english": "en", "hin": "hi", "hindi": "hi", "mar": "mr", "marathi": "mr", "ben": "bn", "bengali": "bn", "bangla": "bn", "tam": "ta", "tamil": "ta", "guj": "gu", "gujarati": "gu", "urd": "ur", "urdu": "ur"}
LETTER = re.compile(r"[^\W\d_]")
NO_WORD = re.compile(r"[\d\s!-/:-@\[-`{-~₹।॥۔،؛؟–—‘’“”…]+")
REMEMBERED = 200_000


def label_code(label: Column) -> Column:
    """A label's language code: two or three letters, with region, in any case, or an English name; else null."""
    base = F.split(F.lower(F.trim(label)), "[-_]")[0]
    known = F.create_map(*[F.lit(x) for pair in {**NAMES, **{c: c for c in LANGUAGES}}.items() for x in pair])
    return F.try_element_at(known, base)


class Grams:
    """Hashed n-gram counts of paragraphs; what a word contributes is remembered."""

    def __init__(self, buckets: int):
        one_thread()
        self.buckets = buckets
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.lists: list[np.ndarray] = []

    def _grams(self, word: str) -> np.ndarray:
        out: list[int] = []
        # a run of one letter, however long, tells no more than three of it
        for part in NO_WORD.split(re.sub(r"(.)\1{3,}", r"\1\1\1", word.lower())):
            if part:
                marked = f"^{part}$"
                out += [zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % self.buckets for n in (1, 2, 3) for i in range(len(marked) - n + 1) if n > 1 or 0 < i < len(marked) - 1]
        return np.array(out, dtype=np.int32)

    def counts(self, paragraphs: list[str]) -> np.ndarray:
        """A row of n-gram counts for each paragraph."""
        if len(self.number) > REMEMBERED:
            self._forget()
        split = [p.split() for p in paragraphs]
        number, lists = self.number, self.lists
        flat = []
        for words in split:
            for w in words:
                n = number.get(w)
                if n is None:
                    n = number[w] = len(lists)
                    lists.append(self._grams(w))
                flat.append(n)
        per = np.fromiter(map(len, split), np.int64, len(split))
        if not flat:
            return np.zeros((len(paragraphs), self.buckets), np.float32)
        # the pairs (paragraph, word) are counted first: repeated words cost once
        pair = np.repeat(np.arange(len(split)), per) * len(lists) + np.array(flat)
        pair, times = np.unique(pair, return_counts=True)
        words = pair % len(lists)
        grams = [lists[w] for w in words.tolist()]
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        place = np.repeat(pair // len(lists) * self.buckets, size) + np.concatenate(grams)
        return np.bincount(place, np.repeat(times, size), len(paragraphs) * self.buckets).reshape(len(paragraphs), self.buckets).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """``centroids`` in rows, with the language (its place in LANGUAGES) and least cosine of each."""

    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    least: np.ndarray

    def classify(self, grams: Grams, paragraphs: list[str]) -> tuple[list[str | None], np.ndarray]:
        """The language of each paragraph (None: rejected) and a confidence in 0..1."""
        langs: list[str | None] = []
        sure = []
        for at in range(0, len(paragraphs), 400):
            v = _unit(grams.counts(paragraphs[at : at + 400]) * self.idf)
            cos = v @ self.centroids.T
            best = cos.argmax(1)
            top = cos[np.arange(len(cos)), best]
            by_lang = np.full((len(cos), len(LANGUAGES)), -1.0)
            for k, lang in enumerate(self.language):
                by_lang[:, lang] = np.maximum(by_lang[:, lang], cos[:, k])
            e = np.exp(12 * (by_lang - top[:, None]))
            ok = top >= self.least[best]
            langs += [LANGUAGES[self.language[b]] if o else None for b, o in zip(best, ok)]
            sure.append(np.where(ok, e[np.arange(len(cos)), self.language[best]] / e.sum(1), 0.0))
        return langs, np.concatenate(sure) if sure else np.zeros(0)


def fit(sample: list[tuple[str, str]], *, buckets: int = 4096, clusters: int = 64, rounds: int = 12, most: int = 9000) -> Model:
    """Centroids from ``(language, text)`` rows; at most ``most`` paragraphs, evenly spread over the rows."""
    rows = [(lang, p, i) for i, (lang, text) in enumerate(sample) for p in (text or "").split("\n\n") if len(LETTER.findall(p)) >= 20]
    step = max(1, -(-len(rows) // most))
    rows = rows[::step]
    if not rows:
        return Model(np.ones(buckets, np.float32), np.zeros((1, buckets), np.float32), np.zeros(1, int), np.full(1, 2.0))
    grams = Grams(buckets)
    x = np.concatenate([grams.counts([p for _, p, _ in rows[i : i + 400]]) for i in range(0, len(rows), 400)])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = _unit(x * idf)
    label = np.array([LANGUAGES.index(lang) for lang, _, _ in rows])
    doc = np.array([i for _, _, i in rows])
    chars = np.array([len(p) for _, p, _ in rows], float)
    # the first centroids: each the paragraph farthest from all before
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(clusters, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[of == k].sum(0) if (of == k).any() else c[k] for k in range(len(c))]))
    # a paragraph's vote counts by how far the rest of its document is in the same language
    cos = x @ c.T
    of = cos.argmax(1)
    votes = np.zeros((len(c), len(LANGUAGES)))
    np.add.at(votes, (of, label), 1.0)
    for _ in range(2):
        named = votes.argmax(1)[of]
        same = np.zeros((doc.max() + 1, len(LANGUAGES)))
        np.add.at(same, (doc, named), chars)
        votes = np.zeros_like(votes)
        np.add.at(votes, (of, label), (same[doc, named] / same.sum(1)[doc]) ** 2)
    keep = votes.sum(1) > 0
    least = np.array([0.5 * np.quantile(cos[of == k, k], 0.01) if keep[k] else 2.0 for k in range(len(c))])
    return Model(idf, c[keep].astype(np.float32), votes.argmax(1)[keep], least[keep])


def labelled_sample(df: DataFrame, doc_id: str, text: str, label: str, per_label: int) -> list[tuple[str, str]]:
    """Up to ``per_label`` documents of each label's language, in order of a hash of their ids."""
    rows = df.select(label_code(F.col(label)).alias("_l"), F.col(text).alias("_t"), F.xxhash64(F.col(doc_id)).alias("_h")).where("_l is not null and length(_t) between 40 and 20000")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_h"))).where(F.col("_n") <= per_label)
    return [(r["_l"], r["_t"]) for r in first.select("_l", "_t").orderBy("_l", "_h").collect()]


def languages(df: DataFrame, doc_id: str, text: str, label: str, model: Model, *, min_letters: int = 20) -> DataFrame:
    """Rows ``(doc_id, segment_no, lang, confidence, label_lang, label_ok)``.

    ``segment_no`` 0 is the document: the language of most characters of its paragraphs
    (of equally many the first in the alphabet), with the share of characters times their
    mean confidence. ``segment_no`` k is the k-th paragraph, where its language is
    another. A text with fewer than ``min_letters`` letters (null and empty ones too), or
    all of whose paragraphs are rejected, gives segment 0 with a null language and
    confidence 0. Repeated rows give repeated rows; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(len(model.idf))
        for pdf in batches:
            paragraphs, owner = [], []
            texts = [t if isinstance(t, str) else "" for t in pdf["_text"]]
            fits = [len(t) >= min_letters and sum(map(str.isalpha, t)) >= min_letters for t in texts]
            for i, t in enumerate(texts):
                if fits[i]:
                    for k, p in enumerate(t.split("\n\n"), 1):
                        if not p.isspace() and p:
                            paragraphs.append(p)
                            owner.append((i, k))
            langs, sure = model.classify(grams, paragraphs)
            chars: list[dict[str, list[float]]] = [{} for _ in texts]
            for (i, _), p, lang, s in zip(owner, paragraphs, langs, sure):
                if lang:
                    e = chars[i].setdefault(lang, [0, 0.0])
                    e[0] += len(p)
                    e[1] += len(p) * s
            main = [min(c, key=lambda x: (-c[x][0], x)) if c else None for c in chars]
            out = [(i, 0, m, c[m][1] / sum(e[0] for e in c.values()) if m else 0.0) for i, (m, c) in enumerate(zip(main, chars))]
            out += [(i, k, lang, float(s)) for (i, k), lang, s in zip(owner, langs, sure) if lang and lang != main[i]]
            made = pd.DataFrame(out, columns=["_row", "segment_no", "lang", "confidence"])
            left = pdf[["_id", "_label"]].iloc[made["_row"]].reset_index(drop=True)
            yield pd.concat([left, made.drop(columns="_row")], axis=1)

    kind = df.schema[doc_id].dataType.simpleString()
    out = spread(df.select(F.col(doc_id).alias("_id"), label_code(F.col(label)).alias("_label"), F.col(text).alias("_text"))).mapInPandas(run, f"_id {kind}, _label string, segment_no bigint, lang string, confidence double")
    return out.select(F.col("_id").alias(doc_id), "segment_no", "lang", "confidence", F.col("_label").alias("label_lang"), F.col("_label").eqNullSafe(F.col("lang")).alias("label_ok"))


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", *, per_label: int = 250) -> DataFrame:
    """Fits the centroids on a sample of ``df`` and gives :func:`languages` of all of it."""
    return languages(df, doc_id, text, label, fit(labelled_sample(df, doc_id, text, label, per_label)))
