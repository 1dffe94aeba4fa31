"""Alignment of quotes with page texts, and geometry of words on pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quote_fold
from ..session import materialise
from .grouped import per_group


def shingles(tokens: Column, size: int) -> Column:
    """The distinct hashes of runs of ``size`` tokens; of a shorter text the hash of the whole."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i + 1, size), " ")))
    return F.array_distinct(many)


def covered(needle: list[str], hay: list[str], least: int = 5, gap: int = 8) -> tuple[int, int, int] | None:
    """``(matched, first, last)``: tokens of the needle found in the hay in order, in runs of at least ``least``, with gaps of at most ``gap`` on either side; a short needle must be found whole (Q1)."""
    least = min(least, len(needle))
    if not needle or not hay:
        return None
    grams: dict[tuple, list[int]] = {}
    for j in range(len(hay) - least + 1):
        grams.setdefault(tuple(hay[j : j + least]), []).append(j)
    at = lambda k: grams.get(tuple(needle[k : k + least]), ()) if k + least <= len(needle) else ()
    best = None
    for k in range(len(needle) - least + 1):
        for first in at(k):
            if k and first and needle[k - 1] == hay[first - 1]:
                continue  # part of a run that begins before
            i, j, matched = k, first, 0
            while True:
                run = 0
                while i + run < len(needle) and j + run < len(hay) and needle[i + run] == hay[j + run]:
                    run += 1
                i, j, matched = i + run, j + run, matched + run
                # the nearest further run, the least tokens left out on both sides together
                step = min(((a + q - j, a, q - j) for a in range(gap + 1) for q in at(i + a) if j <= q <= j + gap), default=None)
                if step is None:
                    break
                i, j = i + step[1], j + step[2]
            if best is None or matched > best[0]:
                best = (matched, first, j - 1)
    return best


def aligned_quotes(quotes: DataFrame, pages: DataFrame, key: str, ident: str, quote: str, page: str, text: str, preferred: str, size: int = 5) -> DataFrame:
    """Rows ``(ident, page, matched, tokens, first, last)``: each quote's best page of its key (Q1, Q2).

    Quotes meet pages by shared runs of ``size`` tokens (an equi-join on key and hash); only
    those pairs are aligned. The preferred page is first among equals, then the smaller.
    Quotes that share nothing with a page have no row: no place is invented.
    """
    toks = lambda c: F.filter(F.split(quote_fold(c), " "), lambda t: t != "")
    q = quotes.where(F.trim(F.coalesce(quote, F.lit(""))) != "").select(F.col(ident).alias("_i"), F.col(key).alias("_k"), F.col(preferred).alias("_pref"), toks(quote).alias("_qt")).where(F.size("_qt") > 0)
    p = pages.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(F.col(key).alias("_k"), F.col(page).alias("_p"), toks(text).alias("_pt"))
    size_of = F.least(F.size("_qt"), F.lit(size))
    qs = q.select("_i", "_k", F.explode(shingles(F.col("_qt"), size)).alias("_h"), size_of.alias("_z"))
    long = qs.where(F.col("_z") == size).join(p.select("_k", "_p", F.explode(shingles(F.col("_pt"), size)).alias("_h")), ["_k", "_h"])
    # a quote of fewer tokens is one shingle of its own length; pages are cut so only for keys that have such quotes
    brief = qs.where(F.col("_z") < size)
    lengths = brief.select("_k", F.col("_z").alias("_l")).distinct()
    cut = p.join(lengths, "_k").select("_k", "_p", "_l", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_pt") - F.col("_l"), F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("_pt", i + 1, F.col("_l")), " ")))).alias("_h"))
    short = brief.join(cut, ["_k", "_h"])
    near = long.select("_i", "_k", "_p").unionByName(short.select("_i", "_k", "_p")).distinct()
    pairs = near.join(q, ["_i", "_k"]).join(p, ["_k", "_p"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, pg, pref, a, b in zip(pdf["_i"], pdf["_p"], pdf["_pref"], pdf["_qt"], pdf["_pt"]):
                got = covered(list(a), list(b), size)
                if got:
                    out.append((i, pg, *got, len(a), pref == pg))
            yield pd.DataFrame(out, columns=["_i", "page", "matched", "first", "last", "tokens", "_pref"])

    kind = quotes.schema[ident].dataType.simpleString()
    found = pairs.select("_i", "_p", "_pref", "_qt", "_pt").mapInPandas(run, f"_i {kind}, page int, matched int, first int, last int, tokens int, _pref boolean")
    w = Window.partitionBy("_i").orderBy(F.desc("matched"), F.desc("_pref"), "page")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("_i").alias(ident), "page", "matched", "tokens", "first", "last")


def contained(quotes: DataFrame, texts: DataFrame, key: str, quote: str, text: str, ident: str, where: str) -> DataFrame:
    """Rows ``(ident, where)``: texts of the same key that hold the quote letter for letter, white space and case aside.

    The second to fourth word of a quote of five words or more stand whole in any text that
    holds it: such quotes meet only texts with that run of words. Shorter ones meet the texts of
    their key that have one word in common with their middle, or, of one or two words, all.
    """
    f = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))
    q = quotes.where(F.trim(F.coalesce(quote, F.lit(""))) != "").select(ident, key, f(quote).alias("_q")).withColumn("_w", F.split("_q", " "))
    t = texts.where(F.col(text).isNotNull()).select(F.col(where), key, f(text).alias("_t")).withColumn("_tw", F.split("_t", " "))
    n = F.size("_w")
    run = F.when(n >= 5, F.array_join(F.slice("_w", 2, 3), " ")).when(n >= 3, F.element_at("_w", 2)).otherwise(F.lit(""))
    runs = F.array_union(F.array_union(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_tw") - 2, F.lit(1))), lambda i: F.array_join(F.slice("_tw", i, 3), " ")), F.col("_tw")), F.array(F.lit("")))
    keyed = t.select(where, key, "_t", F.explode(F.transform(F.array_distinct(runs), lambda x: F.xxhash64(x))).alias("_h"))
    near = q.withColumn("_h", F.xxhash64(run)).join(keyed.drop("_t"), [key, "_h"]).select(ident, "_q", where).distinct()
    return near.join(t.select(where, "_t"), where).where(F.contains("_t", F.col("_q"))).select(ident, where)


def best_binding(evidence: DataFrame, chunks: DataFrame, filing: str, cited: str, quote: str, page: str, ident: str, chunk: str) -> DataFrame:
    """Rows ``(ident, chunk, priority)``: the chunk each piece of evidence is bound to.

    By priority a chunk that is cited and holds the quote (0), that holds it on the cited page
    (1), that holds it (2), that is cited (3); of several the first by ``chunk``. ``quote`` is
    a key of the quoted words. Each group of chunks gives its first one before it is joined.
    """
    out = evidence.select(ident, filing, cited, quote, page)
    for n, keys in enumerate(([filing, cited, quote], [filing, quote, page], [filing, quote], [filing, cited])):
        first = chunks.groupBy(*keys).agg(F.min(chunk).alias(f"_c{n}"))
        out = out.join(first, keys, "left")
    found = F.coalesce(*[F.when(F.col(f"_c{n}").isNotNull(), F.struct(F.col(f"_c{n}").alias("chunk"), F.lit(n).alias("priority"))) for n in range(4)])
    return out.select(ident, found.alias("_f")).where("_f is not null").select(ident, F.col("_f.chunk").alias(chunk), "_f.priority")


def key_bits(keys: DataFrame, key: str, n: int, least: int = 2**10, most: int = 2**20) -> Callable[[Column], Column]:
    """A test of which 64-bit keys are surely not among ``n`` distinct ``keys``: two bits a key in a map of 64 bits a key, 8 MB at most, that travels as a scalar.

    It leaves out no key of ``keys``; of the others some pass, the more the fuller the map is.
    """
    size = min(max(least, 1 << max(n - 1, 0).bit_length()), most)
    places = lambda k: [F.pmod(x, F.lit(size * 64)) for x in (k, F.shiftrightunsigned(k, 32))]
    bit = keys.select(F.explode(F.array(*places(F.col(key)))).alias("_b"))
    words = bit.groupBy(F.shiftright("_b", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(_b & 63 as int)))").alias("_w"))
    whole = keys.sparkSession.range(size).join(words, "id", "left").select(F.struct("id", F.coalesce("_w", F.lit(0)).alias("w")).alias("_s"))
    bits = whole.agg(F.array_sort(F.collect_list("_s")).alias("_s")).select("_s.w").scalar()
    held = lambda b: F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
    return lambda k: reduce(Column.__and__, [held(b) for b in places(k)])


def bound_chunks(evidence: DataFrame, chunks: DataFrame, filing: str, cited: str, quote: str, page: str, ident: str, chunk: str, text: str, first: str, last: str) -> DataFrame:
    """Rows ``(ident, chunk, priority)``: the chunk each piece of evidence is bound to, by its whole quote in the chunk's whole text.

    Priorities and ties as in ``best_binding``; a chunk is on the cited page if it is within
    ``first`` and ``last``. The inner words of a quote stand whole in any text that holds it. So a
    quote has one key, the hash of its filing and of a run of twelve of them, four or one, by its
    length, the rarest among the filing's quotes; one of one or two words has its filing alone. A
    text has the keys of all its runs; those that no quote has are left out where they are made
    (``key_bits``). Texts meet only quotes of their keys, and are then compared letter for letter.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"[\t\n\f\r ]+", " "))
    pair = lambda a, b, k: F.transform(a, lambda x, i: F.xxhash64(x, F.get(b, i + k)))

    def runs(df: DataFrame) -> DataFrame:
        """``_h12``, ``_h4``, ``_h1``: the hashes of runs of so many words from each word of ``_q`` on."""
        df = df.withColumn("_h1", F.transform(F.split("_q", " "), lambda x: F.xxhash64("_f", x)))
        for size, left, right, step in (("2", "_h1", "_h1", 1), ("4", "_h2", "_h2", 2), ("8", "_h4", "_h4", 4), ("12", "_h8", "_h4", 8)):
            df = df.withColumn(f"_h{size}", pair(F.col(left), F.col(right), step))
        return df

    c = chunks.where(F.col(filing).isNotNull()).select(filing, F.col(chunk).alias("_c"), F.col(cited).alias("_c2"), F.col(first).alias("_a"), F.col(last).alias("_z"), F.col(text).alias("_t"))
    e = evidence.select(ident, filing, F.col(cited).alias("_c2"), F.col(page).alias("_p"), fold(quote).alias("_q"), (F.trim(F.coalesce(quote, F.lit(""))) != "").alias("_some"))
    e = materialise(e.join(c.select(filing).distinct(), filing, "left_semi"))

    q = materialise(e.where("_some").select(F.xxhash64(filing).alias("_f"), "_q").distinct().withColumn("_i", F.monotonically_increasing_id()))
    n, alone = F.size("_h1"), F.array(F.xxhash64("_f"))
    inner = lambda size: F.slice(f"_h{size}", F.lit(2), n - 1 - size)
    own = F.when(n >= 14, inner(12)).when(n >= 6, inner(4)).when(n >= 3, inner(1)).otherwise(alone)
    able = runs(q).select("_i", F.explode(F.array_distinct(own)).alias("_k"))
    rarest = able.join(able.groupBy("_k").agg(F.count("*").alias("_n")), "_k").groupBy("_i").agg(F.min(F.struct("_n", "_k")).alias("_r"))
    q = materialise(q.join(rarest, "_i").select(F.col("_r._k").alias("_k"), "_q"))
    keys = q.select("_k").distinct()
    among = key_bits(keys, "_k", keys.count())

    texts = c.where("_t is not null").select(F.xxhash64(filing, "_c", "_t").alias("_o"), filing, "_c", "_c2", "_a", "_z", fold("_t").alias("_t"))
    words = runs(texts.select("_o", F.xxhash64(filing).alias("_f"), F.col("_t").alias("_q")))
    made = words.select("_o", F.explode(F.array_distinct(F.concat("_h12", "_h4", "_h1", alone))).alias("_k"))
    near = made.where(among(F.col("_k"))).repartition("_k").distinct().join(q, "_k").select("_o", "_q")

    held = near.join(texts, "_o").where(F.contains("_t", "_q"))
    hits = held.groupBy(filing, "_q", F.col("_c2").alias("_part"), "_a", "_z").agg(F.min("_c").alias("_c"))
    rank = F.when(F.col("_c2") == F.col("_part"), 0).when(F.col("_p").between(F.col("_a"), F.col("_z")), 1).otherwise(2)
    bound = e.where("_some").join(hits, [filing, "_q"]).select(ident, rank.alias("priority"), "_c")
    lead = c.where("_c2 is not null").groupBy(filing, "_c2").agg(F.min("_c").alias("_c"))
    both = bound.unionByName(e.join(lead, [filing, "_c2"]).select(ident, F.lit(3).alias("priority"), "_c"))
    best = both.groupBy(ident).agg(F.min(F.struct("priority", F.col("_c").isNull().alias("_none"), "_c")).alias("_b"))
    return best.select(ident, F.col("_b._c").alias(chunk), "_b.priority")


def visual_lines(df: DataFrame, key: str, ident: str, gutter: float = 0.045) -> DataFrame:
    """Rows ``(key, ident, line, span)`` of words ``(key, ident, x, y, w, h)``: words on one line overlap by half the lower one's height; a wide gap parts a line.

    Bands grow with each word, so a page's words are read in order, one page at a time.
    """

    def run(words: list[dict]) -> list[tuple]:
        bands: list[list[float]] = []
        lines: list[list[dict]] = []
        for x in words:
            y, h = x["y"], x["h"]
            at = next((i for i, (a, b) in enumerate(bands) if min(b, y + h) - max(a, y) >= 0.5 * min(b - a, h)), None)
            if at is None:
                bands.append([y, y + h])
                lines.append([x])
            else:
                bands[at] = [min(bands[at][0], y), max(bands[at][1], y + h)]
                lines[at].append(x)
        out, n = [], -1
        for at, line in enumerate(lines):
            line.sort(key=lambda v: (v["x"], v[ident]))
            gaps = [0.0, *(b["x"] - a["x"] - a["w"] for a, b in zip(line, line[1:]))]
            wide = sorted(g for g in gaps if g > 0)
            m = (wide[(len(wide) - 1) // 2] + wide[len(wide) // 2]) / 2 if wide else 0.0
            for k, (v, g) in enumerate(zip(line, gaps)):
                n += k == 0 or g > max(gutter, 4 * m)
                out.append((v[ident], at, n))
        return out

    kind = df.schema[ident].dataType.simpleString()
    return per_group(df.select(key, ident, "x", "y", "w", "h"), [key], ["y", "x", ident], run, f"`{ident}` {kind}, line int, span int")


def without_jumps(df: DataFrame, key: str, order: str, jump: float, least: int) -> DataFrame:
    """``df`` without short runs of words (under ``least``) between jumps of ``y`` (W16); by windows alone."""
    w = Window.partitionBy(key).orderBy(order)
    cut = F.when(F.abs(F.col("y") - F.lag("y").over(w)) > jump, 1).otherwise(0)
    runs = df.withColumn("_c", cut).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = runs.withColumn("_n", F.count("*").over(Window.partitionBy(key, "_run"))).withColumn("_longest", F.max("_n").over(Window.partitionBy(key)))
    return sized.where((F.col("_n") >= least) | (F.col("_n") == F.col("_longest"))).drop("_c", "_run", "_n", "_longest")


def margins(df: DataFrame, key: list[str], horizontal: float = 113.4, vertical: float = 56.7, width: float = 595.0, height: float = 842.0, tolerance: float = 3.0) -> DataFrame:
    """Per page its margins in points from boxes of 0..1, and whether they are wide enough."""
    m = df.groupBy(*key).agg((F.min("x") * width).alias("left"), ((1 - F.max(F.col("x") + F.col("w"))) * width).alias("right"), (F.min("y") * height).alias("top"), ((1 - F.max(F.col("y") + F.col("h"))) * height).alias("bottom"))
    ok = (F.least("left", "right") + tolerance >= horizontal) & (F.least("top", "bottom") + tolerance >= vertical)
    return m.select(*key, *[F.bround(c, 2).alias(c) for c in ("left", "right", "top", "bottom")], ok.alias("wide_enough"))
