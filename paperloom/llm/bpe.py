"""Encoding a corpus with a public byte-level BPE tokenizer, by recursive SQL.

Every partition runs DuckDB in its Python worker. A text falls into words by the
tokenizer's own pattern; each word that the worker hasn't met yet becomes token-position
rows, one per byte. A recursive query joins neighbouring rows to the merge table and
contracts, from the left, the pairs of lowest rank until no pair is left; rows are keyed by
word and position, so that a round replaces what it changes, and words that are done
leave the recursion. Ordered aggregation gives a word's ids, and decodes them.

A round contracts every pair that ranks lowest among all pairs from ``reach`` tokens
before it to twice as many behind. That gives what the lowest pair of the word, one place at a
time, gives: a merge makes possible only pairs that rank behind it, so whatever could take
a token from the pair would have to begin with a lower pair, and grow to a token that
holds both, which is no longer than ``reach`` bytes, the longest token there is. Equal
pairs that overlap (as in "aaa") are taken in turn from the left end of their run, and wait
where that end isn't settled yet. A "word" of n letters takes about as many rounds as
a short one, some dozens.

The memory of words already encoded (``REMEMBERED`` at most) starts afresh when full; it
changes the speed, never the result.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

TOKENIZERS = "/opt/tokenizers"
#: The words of this family of tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 300_000

#: The step makes each round's rows new ones: rows that a round leaves as they were would not be seen by the next.
ROUNDS = """
WITH RECURSIVE t(w, pos, tok, step) USING KEY (w, pos) AS (
  SELECT w, pos, tok, 0 FROM start
  UNION
  SELECT w, pos, CASE WHEN eaten THEN NULL WHEN taken THEN made ELSE tok END, step + 1
  FROM (SELECT *, lag(taken, 1, false) OVER ordered AS eaten, max(taken) OVER (PARTITION BY w) AS goes_on
        FROM (SELECT *, hit AND last % 2 = 0 AND (n - last // 2) % 2 = 1 AS taken
              FROM (SELECT *, coalesce(max(CASE WHEN NOT hit THEN 2 * n + CASE WHEN rank = after THEN 1 ELSE 0 END END) OVER ordered, 0) AS last
                    FROM (SELECT *, coalesce(rank = min(rank) OVER near, false) AS hit, row_number() OVER ordered AS n, lead(rank) OVER ordered AS after
                          FROM (SELECT x.*, m.rank, m.made
                                FROM (SELECT *, lead(tok) OVER ordered AS nxt FROM t WHERE tok IS NOT NULL WINDOW ordered AS (PARTITION BY w ORDER BY pos)) x
                                LEFT JOIN merges m ON m.a = x.tok AND m.b = x.nxt) y
                          WINDOW ordered AS (PARTITION BY w ORDER BY pos), near AS (PARTITION BY w ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {twice} FOLLOWING)) z
                    WINDOW ordered AS (PARTITION BY w ORDER BY pos)) v) u
        WINDOW ordered AS (PARTITION BY w ORDER BY pos)) s
  WHERE goes_on)
SELECT w, list(tok ORDER BY pos) AS ids FROM t WHERE tok IS NOT NULL GROUP BY w ORDER BY w
"""


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each id, and the merges as rows ``(a, b, rank, made)``."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ids = model["vocab"]
        tokens = [b""] * (max(ids.values()) + 1)
        for text, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in text)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return tokens, np.array([(ids[a], ids[b], r, ids[a + b]) for r, (a, b) in enumerate(pairs)], dtype=np.int64)
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = token
    rows = [(ids[t[:k]], ids[t[k:]], i, i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
    return tokens, np.array(rows, dtype=np.int64)


class _Words(dict):
    """A number for each word; words met for the first time wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes batches of texts; one per Python worker."""

    def __init__(self, path: str, pattern: str = PATTERN, remembered: int = REMEMBERED):
        import duckdb
        import regex

        tokens, merges = vocabulary(path)
        self.tokens, self.remembered = tokens, remembered
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.byte_id[t[0]] = i
        # the longest token of letters alone, with a blank before it, and of all: how far a merge can reach
        plain = re.compile(rb" ?[A-Za-z]+")
        self.letters, self.reach = max((len(t) for t in tokens if plain.fullmatch(t)), default=1), max(map(len, tokens), default=1)
        self.of_letters = plain.fullmatch
        self.words_of = regex.compile(pattern).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        self.con.register("given", pa.table({k: merges[:, i] for i, k in enumerate(("a", "b", "rank", "made"))}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.begin, self.size = _Words(), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in self.words.new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        # what is no word of letters can reach as far as the longest token of any kind
        reach = self.letters if all(n <= self.letters or self.of_letters(w) for n, w in zip(lengths.tolist(), raw)) else self.reach
        of = np.repeat(np.arange(len(raw)), lengths)
        pos = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first = pa.table({"w": of, "pos": pos, "tok": self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]})
        self.con.register("start", first)
        lists = self.con.sql(ROUNDS.format(reach=reach, twice=2 * reach)).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("start")
        size = np.diff(np.asarray(lists.offsets))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.asarray(lists.flatten()).astype(np.int32)])
        self.words.new = []

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of ``texts`` in order, and how many each text has."""
        if len(self.words) > self.remembered:
            self._forget()
        split = [self.words_of(t) if t else () for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((n for ws in split for n in map(self.words.__getitem__, ws)), np.int64, int(counts.sum()))
        if self.words.new:
            self._learn()
        return flat, counts

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """How many tokens each text has."""
        words, counts = self.numbers(texts)
        total = np.concatenate([[0], np.cumsum(self.size[words])])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in order, and where each text's begin (one entry more than texts)."""
        words, counts = self.numbers(texts)
        size = self.size[words]
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.begin[words] - total[:-1], size) + np.arange(total[-1])
        return self.flat[place], total[np.concatenate([[0], np.cumsum(counts)])]


def encode_column(df: DataFrame, key: str, text: str, *, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS, pattern: str = PATTERN) -> DataFrame:
    """Rows ``(key, ids)``: the ids of each text, without special tokens.

    Null and empty texts give an empty list; the names of special tokens in a text are
    ordinary text. Each row gives a row, repeated ones too; an empty table gives none.
    """
    path = f"{folder}/{tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path, pattern)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, F.col(text).alias("_text"))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, *, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS, pattern: str = PATTERN) -> DataFrame:
    """Rows ``(*keep, n_tokens)``: how many ids each text has; 0 for null and empty texts."""
    path = f"{folder}/{tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path, pattern)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = encoder.lengths(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n.astype(np.int64))], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return spread(df.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode_column(spark: SparkSession, df: DataFrame, key: str, ids: str, *, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """Rows ``(key, text)``: the texts that the ids stand for; bytes that aren't UTF-8 become U+FFFD."""
    path = f"{folder}/{tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        tokens = vocabulary(path)[0]
        con.register("v", pa.table({"id": list(range(len(tokens))), "hex": [t.hex() for t in tokens]}))
        con.execute("CREATE TABLE vocab AS SELECT * FROM v")
        for batch in batches:
            con.register("given", pa.table({"n": list(range(batch.num_rows)), "ids": batch.column(1)}))
            got = con.execute(
                "SELECT n, coalesce(string_agg(hex, '' ORDER BY pos), '') FROM (SELECT n, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM given) JOIN vocab USING (id) GROUP BY n"
            ).fetchall()
            con.unregister("given")
            texts = [""] * batch.num_rows
            for n, hexed in got:
                texts[n] = bytes.fromhex(hexed).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(ids).alias("_ids")).mapInArrow(run, f"`{key}` {kind}, text string")
