"""Splitting oversized texts at natural boundaries.

A text over the limit is cut by the strongest separator that helps: section, then
paragraph, line, sentence, clause, word, and only then between characters. Pieces are
packed greedily up to the limit, and each piece after the first begins with up to
``overlap`` characters of the one before, from a word's start where there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: From the strongest to the weakest: where a cut may follow. Each pattern's match stays with the text before the cut.
SEPARATORS = [re.compile(p) for p in (r"\n(?=(?:#+ |[A-Z][A-Z &/\-]{7,}\n|(?:[IVX]+|\d+)\.\s))|\f", r"\n[ \t]*\n+", r"\n", r"[.!?।۔][\"'’”)]*\s+", r"[;:,]\s+", r"\s+")]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of each piece, the overlap included; no piece is longer than ``limit`` code points."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = min(overlap, limit // 2)
    marks: list[list[int]] = [[m.end() for m in p.finditer(text)] for p in SEPARATORS]
    at = [0] * len(marks)
    pieces, start, fresh = [], 0, 0  # fresh: where text that no piece holds yet begins
    while True:
        if n - start <= limit:
            pieces.append((start, n))
            return pieces
        end = start + limit
        low = max(fresh + 1, start + limit // 2)
        cut = 0
        for k, places in enumerate(marks):
            i = at[k]
            while i < len(places) and places[i] <= fresh:
                i += 1
            at[k] = i
            while i < len(places) and places[i] <= end:
                i += 1
            best = places[i - 1] if i > at[k] else 0
            if best >= low:
                cut = best
                break
            if not cut and best > fresh and k == len(marks) - 1:
                cut = best
        cut = cut or end
        pieces.append((start, cut))
        fresh = cut
        back = max(start + 1, cut - overlap)
        words = re.search(r"\s\S", text[back : cut])
        start = back + words.start() + 1 if words else back
        if limit - (cut - start) < 1:
            start = cut


def split_oversized(df: DataFrame, order: Sequence[str], key: Sequence[str], row_id: str, text: str, *, limit: int = 3500, overlap: int = 200, only_oversized: bool = False) -> DataFrame:
    """Rows ``(*key, row_id, piece_no, part, n_parts, start, piece)``.

    ``part`` counts from 0 within a text, ``start`` is the piece's place in it, and
    ``piece_no`` goes on from 0 over all texts of a ``key`` in the order given (ties by
    row id; null keys form a key of their own). A text up to the limit is one piece.
    Rows repeated under one id count once; null texts give no piece, an empty text one
    empty piece; an empty table gives no rows.
    """
    use = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(row_id).alias("_id"), F.col(text).alias("_t")).where("_t is not null")
    keep = [c for c in use.columns if c != "_t"]
    big = use.where(F.length("_t") > limit).dropDuplicates(["_id"])
    small = use.where(F.length("_t") <= limit).dropDuplicates(["_id"])
    kinds = {f.name: f.dataType.simpleString() for f in use.schema}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(_n=[len(cut_points(t, limit, overlap)) for t in pdf["_t"]])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, j, len(cuts), a, t[a:b]) for i, t in zip(pdf["_id"], pdf["_t"]) for cuts in [cut_points(t, limit, overlap)] for j, (a, b) in enumerate(cuts)]
            yield pd.DataFrame(out, columns=["_id", "part", "n_parts", "start", "piece"])

    # the texts are numbered by how many pieces each has, without the texts
    sizes = big.mapInPandas(count, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", _n int")
    if not only_oversized:
        sizes = sizes.unionByName(small.select(*keep, F.lit(1).alias("_n")))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy(*[f"_o{i}" for i in range(len(order))], "_id")
    numbers = materialise(sizes.withColumn("_first", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).select("_id", *[f"_k{i}" for i in range(len(key))], "_first"))
    pieces = big.select("_id", "_t").mapInPandas(cut, f"_id {kinds['_id']}, part int, n_parts int, start int, piece string").join(numbers, "_id")
    if not only_oversized:
        one = small.select("_id", F.lit(0).alias("part"), F.lit(1).alias("n_parts"), F.lit(0).alias("start"), F.col("_t").alias("piece")).join(numbers, "_id")
        pieces = pieces.unionByName(one)
    return pieces.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)], F.col("_id").alias(row_id), (F.col("_first") + F.col("part")).cast("int").alias("piece_no"), "part", "n_parts", "start", "piece")
