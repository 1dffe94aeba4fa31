"""Windows and chunks of page texts, record assembly, and the reverse."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_folio_only, scoped_id

#: Where a window may end, from the strongest pause to the weakest.
PAUSES = ("\n\n", "\n", ". ", " ")


def windows(text: str, size: int = 3500, overlap: int = 200) -> list[str]:
    """The windows of a text: each ends at the strongest pause in its last quarter, and begins ``overlap`` before the last one's end."""
    out, at, n = [], 0, len(text)
    while at < n:
        stop = min(n, at + size)
        if stop < n:
            floor = at + size - size // 4
            stop = next((k + len(p) for p in PAUSES if (k := text.rfind(p, floor, stop)) >= 0), stop)
        piece = text[at:stop].strip()
        if piece:
            out.append(piece)
        if stop >= n:
            break
        at = max(at + 1, stop - overlap)
    return out


def mapped(df: DataFrame, keep: Sequence[str], text: str, make: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``keep`` with what ``make`` gives for each text; null texts give none."""
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *x) for i, t in enumerate(pdf["_text"]) for x in make(t)]
            made = pd.DataFrame(rows, columns=["_i", *names])
            left = pdf[list(keep)].iloc[made["_i"]].reset_index(drop=True)
            yield pd.concat([left, made.drop(columns="_i")], axis=1)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(text).alias("_text")).where("_text is not null").mapInPandas(run, f"{kinds}, {schema}")


def text_windows(df: DataFrame, keep: Sequence[str], text: str, size: int = 3500, overlap: int = 200) -> DataFrame:
    """Rows ``(*keep, window, piece)`` of boundary-aware windows."""
    return mapped(df, keep, text, lambda t: list(enumerate(windows(t, size, overlap))), "window int, piece string")


def fixed_windows(df: DataFrame, keep: Sequence[str], text: str, size: int, stride: int) -> DataFrame:
    """Rows ``(*keep, window, piece)`` of windows at fixed places, without Python."""
    n = F.greatest(F.ceil((F.length(text) - size) / stride), F.lit(0)).cast("int")
    at = df.where(F.length(text) > 0).select(*keep, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n)).alias("window"))
    return at.select(*keep, "window", F.substring(F.col("_t"), F.col("window") * stride + 1, F.lit(size)).alias("piece"))


def blocks(text: str) -> list[tuple[str, str]]:
    """The blocks of a page: (kind, text) with kind heading, row or text."""
    out: list[tuple[str, str]] = []
    header: list[str] | None = None
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            header = None
            out.append(("gap", ""))
        elif s.count("|") >= 2:
            cells = [c.strip() for c in s.strip("|").split("|")]
            if all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                continue
            if header is None or len(header) != len(cells):
                header = cells
                out.append(("row", " | ".join(cells)))
            else:
                out.append(("row", "; ".join(f"{h}: {c}" for h, c in zip(header, cells) if c)))
        elif re.match(r"#{1,6} ", s) or len(s) > 3 and s.upper() == s and any(ch.isalpha() for ch in s) and len(s) < 90:
            out.append(("heading", s.lstrip("# ")))
        elif out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + "\n" + s)
        else:
            out.append(("text", s))
    return [b for b in out if b[0] != "gap"]


def semantic_chunks(text: str, target: int = 500, most: int = 900, overlap: int = 80, tokens: Callable[[str], int] = lambda t: len(t.split())) -> list[tuple[int, str, str, int]]:
    """Chunks ``(number, heading, text, tokens)`` of a page.

    A heading opens a chunk; blocks are packed up to ``target`` tokens; a block over ``most``
    is cut at words with ``overlap`` tokens repeated; a chunk of hardly any information (under
    10 tokens or 40 characters) joins its neighbour.
    """
    made: list[tuple[str, str]] = []
    heading, held = "", []
    flush = lambda: made.append((heading, "\n".join(held))) if held else None
    for kind, block in blocks(text):
        if kind == "heading":
            flush()
            heading, held = block, []
            continue
        words = block.split()
        if tokens(block) > most:
            flush()
            held = []
            at = 0
            while at < len(words):
                made.append((heading, " ".join(words[at : at + target])))
                at += target if at + target >= len(words) else target - overlap
            continue
        if held and tokens("\n".join(held)) + tokens(block) > target:
            flush()
            held = []
        held.append(block)
    flush()
    out: list[tuple[str, str]] = []
    for h, t in made:
        low = len(t) < 40 or tokens(t) < 10
        if out and low and tokens(out[-1][1]) + tokens(t) <= most:
            out[-1] = (out[-1][0], out[-1][1] + "\n" + t)
        elif len(out) == 1 and (len(out[0][1]) < 40 or tokens(out[0][1]) < 10):
            out[0] = (out[0][0] or h, out[0][1] + "\n" + t)
        else:
            out.append((h, t))
    return [(i, h, t, tokens(t)) for i, (h, t) in enumerate(out)]


def page_chunks(df: DataFrame, keep: Sequence[str], text: str, **limits) -> DataFrame:
    """Rows ``(*keep, chunk_no, heading, chunk, tokens)`` of :func:`semantic_chunks`."""
    return mapped(df, keep, text, lambda t: semantic_chunks(t, **limits), "chunk_no int, heading string, chunk string, tokens int")


def page_records(df: DataFrame, scope: Sequence[str], page: str, text: str, size: int = 3500, overlap: int = 200) -> DataFrame:
    """Rows ``(record_id, *scope, page, chunk_kind, window, chunk)``: the index records of pages.

    An empty page gives a manifest record, a page with nothing but a folio or heading a
    stub without text, any other its windows. Ids are the scope's hash, page and window.
    """
    base = scoped_id(*scope)
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    kind = F.when(blank, "page_manifest").when(is_folio_only(text), "page_stub").otherwise("page")
    rows = df.withColumn("_kind", kind).withColumn("_base", base)
    bare = rows.where("_kind <> 'page'").select(*scope, page, "_base", F.col("_kind").alias("chunk_kind"), F.lit(0).alias("window"), F.lit(None).cast("string").alias("chunk"))
    full = text_windows(rows.where("_kind = 'page'"), [*scope, page, "_base"], text, size, overlap).withColumn("chunk_kind", F.lit("page")).withColumnRenamed("piece", "chunk")
    both = bare.unionByName(full)
    return both.select(F.concat("_base", F.lit(":page:"), F.col(page).cast("string"), F.lit(":"), F.col("window").cast("string")).alias("record_id"), *scope, page, "chunk_kind", "window", "chunk")


def with_segments(before: Column, text: Column, after: Column, page: Column) -> Column:
    """A page's text with labelled parts of its neighbours around it."""
    part = lambda p, t: F.when(t.isNotNull(), F.concat(F.lit("[page "), p.cast("string"), F.lit("]\n"), t))
    return F.concat_ws("\n\n", part(page - 1, before), part(page, text), part(page + 1, after))


def segments(c: str | Column) -> Column:
    """The texts of the pages labelled in a text, as a map from page to text (C4)."""
    x = F.col(c) if isinstance(c, str) else c
    pattern = F.lit(r"(?s)\[page (\d+)\]\n(.*?)(?=\n\n\[page \d+\]\n|\z)")
    return F.map_from_arrays(F.transform(F.regexp_extract_all(x, pattern, 1), lambda p: p.cast("int")), F.regexp_extract_all(x, pattern, 2))


def described(df: DataFrame, keep: Sequence[str], fields: dict[str, Column]) -> DataFrame:
    """Rows ``(*keep, description)``: one ``Label: value`` line for each field that has a value."""
    line = lambda k, v: F.when(v.isNotNull() & (F.trim(v) != ""), F.concat(F.lit(f"{k}: "), v))
    return df.select(*keep, F.concat_ws("\n", *[line(k, v.cast("string")) for k, v in fields.items()]).alias("description"))


def merged_record(pages_a: Column, pages_b: Column, tokens_a: Column, tokens_b: Column, text_a: Column, text_b: Column, joint: int = 12) -> Column:
    """What two short records give as one: pages, tokens and text, hashed again."""
    text = F.concat_ws("\n\n", text_a, text_b)
    return F.struct(F.sort_array(F.array_union(pages_a, pages_b)).alias("pages"), (tokens_a + tokens_b + joint).alias("tokens"), text.alias("text"), F.sha2(text, 256).alias("content_hash"))


def fetched_windows(df: DataFrame, base: str, page: str, window: str, text: str, thin: int = 500, most: int = 4) -> DataFrame:
    """Rows ``(base, page, text)``: windows of a page while the text before is thin.

    Window 0 counts always; another only while the one before it was there, the text so far
    is under ``thin`` characters and fewer than ``most`` were read. Empty pages are left out.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(base, page).orderBy(window)
    n = F.row_number().over(w)
    upto = F.sum(F.length(F.coalesce(text, F.lit(""))) + 2).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = df.withColumn("_n", n).withColumn("_u", F.coalesce(upto, F.lit(0)) - 2).where((F.col("_n") == F.col(window) + 1) & (F.col("_n") <= most) & ((F.col(window) == 0) | (F.col("_u") < thin)))
    out = kept.groupBy(base, page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(window, F.col(text).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    return out.where("trim(text) <> ''")
