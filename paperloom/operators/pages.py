"""Page maps: islands, spans, coverage, stitching and neighbours.

A page map is a table with one row per (filing, label, page). All operators take the key
columns as parameters, work per key in windows that hold one filing's pages, and shuffle
once on those keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand_spans(df: DataFrame, spans: str) -> DataFrame:
    """One row per page of each valid inclusive span of the array column ``spans`` (J7); faulty spans give none."""
    span = df.withColumn("_span", F.explode(spans)).where("_span.start >= 1 and _span.start <= _span.end")
    return span.withColumn("page", F.explode(F.expr("sequence(_span.start, _span.end)"))).drop("_span", spans)


def islands(df: DataFrame, keys: Sequence[str], page: str = "page") -> DataFrame:
    """Rows ``(*keys, start, end, pages)``: the contiguous runs of pages of each key.

    Repeated pages count once; null pages are left out; null keys form a key of their own.
    """
    one = df.select(*keys, F.col(page).alias("_p")).where("_p is not null").distinct()
    w = Window.partitionBy(*keys).orderBy("_p")
    run = one.withColumn("_run", F.col("_p") - F.row_number().over(w))
    return run.groupBy(*keys, "_run").agg(F.min("_p").alias("start"), F.max("_p").alias("end"), F.count("*").alias("pages")).drop("_run")


def first_run(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key's runs the first."""
    w = Window.partitionBy(*keys).orderBy("start")
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def longest_run(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key's runs the longest, of equally long ones the earliest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("pages"), "start")
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def kept_runs(runs: DataFrame, filing: str, label: str, keep_all: Sequence[str], first_only: Column) -> DataFrame:
    """Repeated labels reduced to one run (W2): ``first_only`` labels keep their first run, those of ``keep_all`` all, others the longest."""
    w = Window.partitionBy(filing, label)
    ranked = runs.withColumn("_first", F.row_number().over(w.orderBy("start"))).withColumn("_long", F.row_number().over(w.orderBy(F.desc("pages"), "start")))
    keep = F.when(F.col(label).isin(*keep_all), True).when(first_only, F.col("_first") == 1).otherwise(F.col("_long") == 1)
    return ranked.where(keep).drop("_first", "_long")


def span_text(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ``(*keys, phrase)``: the runs as one phrase, ``p. 3`` or ``pp. 3–5, 9``."""
    piece = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat(F.col("start").cast("string"), F.lit("–"), F.col("end").cast("string")))
    parts = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", piece.alias("t")))).alias("_a"), F.sum("pages").alias("_n"))
    text = F.array_join(F.transform("_a", lambda x: x["t"]), ", ")
    return parts.select(*keys, F.concat(F.when(F.col("_n") == 1, F.lit("p. ")).otherwise(F.lit("pp. ")), text).alias("phrase"))


def label_spans(df: DataFrame, filing: str, label: str, page: str = "page") -> DataFrame:
    """Rows ``(filing, label, start, end, ord)``: first and last page of each label, numbered by first appearance."""
    spans = df.groupBy(filing, label).agg(F.min(page).alias("start"), F.max(page).alias("end"))
    return spans.withColumn("ord", F.row_number().over(Window.partitionBy(filing).orderBy("start", label)))


def merged_spans(df: DataFrame, filing: str, label: str, groups: dict[str, str], page: str = "page") -> DataFrame:
    """:func:`label_spans` with labels of one group (``label -> group``) as one document."""
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return label_spans(df.withColumn(label, F.coalesce(F.try_element_at(pairs, F.col(label)), F.col(label))), filing, label, page)


def coverage_gaps(df: DataFrame, keys: Sequence[str], page: str = "page") -> DataFrame:
    """Rows ``(*keys, page)``: pages between a key's first and last that no row has."""
    one = df.select(*keys, F.col(page).alias("_p")).where("_p is not null").distinct()
    nxt = F.lead("_p").over(Window.partitionBy(*keys).orderBy("_p"))
    holes = one.withColumn("_n", nxt).where("_n > _p + 1")
    return holes.select(*keys, F.explode(F.expr("sequence(_p + 1, _n - 1)")).alias("page"))


def leftover_pages(totals: DataFrame, used: DataFrame, key: str, count: str, page: str = "page") -> DataFrame:
    """Rows ``(key, page)``: pages 1..count of each key that ``used`` hasn't."""
    every = totals.select(key, F.explode(F.sequence(F.lit(1), F.col(count))).alias("page")).where(F.col(count) >= 1)
    return every.join(used.select(key, F.col(page).alias("page")).distinct(), [key, "page"], "left_anti")


def slot_pages(pages: DataFrame, slots: DataFrame, filing: str, label: str, slot: str, page: str = "page") -> DataFrame:
    """Rows ``(filing, slot, pages)``: the sorted pages of each slot whose labels (``slots``: label, slot) are on them."""
    hit = pages.join(slots.select(F.col(label), F.col(slot)).distinct(), label)
    return hit.groupBy(filing, slot).agg(F.sort_array(F.collect_set(page)).alias("pages"))


def renumbered(df: DataFrame, spans: DataFrame, filing: str, slot: str, complete: bool = True, page: str = "page") -> DataFrame:
    """Rows ``(filing, slot, local_page, page)``: a slot's source pages renumbered 1..n in order of its spans.

    ``spans`` has ``filing, slot, start, end``. With ``complete`` a slot of whose pages one is
    missing in ``df`` gives nothing.
    """
    want = spans.where("start >= 1 and start <= end").select(filing, slot, "start", F.explode(F.sequence("start", "end")).alias("page")).groupBy(filing, slot, "page").agg(F.min("start").alias("start"))
    w = Window.partitionBy(filing, slot)
    numbered = want.withColumn("local_page", F.row_number().over(w.orderBy("start", "page"))).withColumn("_want", F.count("*").over(w))
    got = numbered.join(df.select(filing, F.col(page).alias("page")).distinct(), [filing, "page"])
    if complete:
        got = got.withColumn("_got", F.count("*").over(w)).where("_got = _want")
    return got.select(filing, slot, "local_page", "page")


def stitched(df: DataFrame, filing: str, order: Sequence[str], local: str = "page") -> DataFrame:
    """``df`` with ``global_page``: pages of a filing's files counted on in the order given."""
    return df.withColumn("global_page", F.row_number().over(Window.partitionBy(filing).orderBy(*order, local)))


def neighbour_overlap(df: DataFrame, filing: str, page: str, labels: str, text: str, chars: int = 200) -> DataFrame:
    """``df`` with ``before`` and ``after``: the end of the page before and the start of the page behind, where they share a label."""
    w = Window.partitionBy(filing).orderBy(page)
    lag = lambda c, n: F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w)
    shares = lambda n: (F.abs(lag(F.col(page), n) - F.col(page)) == 1) & F.arrays_overlap(F.col(labels), lag(F.col(labels), n))
    return df.withColumn("before", F.when(shares(1), F.right(lag(F.col(text), 1), F.lit(chars)))).withColumn("after", F.when(shares(-1), F.left(lag(F.col(text), -1), F.lit(chars))))


def adjacent(df: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str, count: int = 2) -> DataFrame:
    """Rows ``(ident, neighbour, step)``: up to ``count`` rows before (negative steps) and behind each row of a key."""
    numbered = df.select(*keys, F.col(ident), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_n"))
    steps = F.array(*[F.lit(s) for s in range(-count, count + 1) if s])
    want = numbered.select(*keys, F.col(ident), F.explode(steps).alias("step"), "_n").withColumn("_m", F.col("_n") + F.col("step"))
    other = numbered.select(*keys, F.col(ident).alias("neighbour"), F.col("_n").alias("_m"))
    return want.join(other, [*keys, "_m"]).select(ident, "neighbour", "step")


def nearest_same_part(short: DataFrame, full: DataFrame, keys: Sequence[str], ident: str, page: str) -> DataFrame:
    """Rows ``(ident, nearest, distance)``: for each short row the nearest full row of its key; of equally near ones the earlier page.

    As-of in both directions: short and full rows stand in one order, and each short row
    takes the last full one before it and the first behind it; no pairs are made.
    """
    cols = lambda df, kind: df.select(*keys, F.col(ident).alias("_id"), F.col(page).alias("_p"), F.lit(kind).alias("_full"))
    both = cols(short, False).unionByName(cols(full, True))
    mark = F.when(F.col("_full"), F.struct(F.col("_p").alias("p"), F.col("_id").alias("id")))
    w = Window.partitionBy(*keys)
    before = F.last(mark, True).over(w.orderBy("_p", F.desc("_full"), F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(mark, True).over(w.orderBy(F.desc("_p"), F.desc("_full"), F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_b", before).withColumn("_a", after).where("not _full")
    db, da = F.col("_p") - F.col("_b.p"), F.col("_a.p") - F.col("_p")
    take = F.when(F.col("_a").isNull() | (db <= da), F.col("_b")).otherwise(F.col("_a"))
    return found.withColumn("_t", take).where("_t is not null").select(*keys, F.col("_id").alias(ident), F.col("_t.id").alias("nearest"), F.abs(F.col("_t.p") - F.col("_p")).alias("distance"))


def continuation_pages(df: DataFrame, filing: str, label: str, page: str = "page") -> DataFrame:
    """Rows of ``df`` whose filing has the same label on the page before, with ``previous_page``."""
    prev = df.select(F.col(filing), F.col(label), (F.col(page) + 1).alias(page), F.col(page).alias("previous_page")).distinct()
    return df.join(prev, [filing, label, page])


def run_segments(df: DataFrame, filing: str, page: str, value: Column) -> DataFrame:
    """Rows ``(filing, segment_id, start, end, value)``: runs of consecutive pages with one value."""
    w = Window.partitionBy(filing).orderBy(page)
    v = df.select(F.col(filing), F.col(page).alias("_p"), value.alias("value"))
    cut = F.when((F.lag("_p").over(w) + 1 == F.col("_p")) & F.lag("value").over(w).eqNullSafe(F.col("value")), 0).otherwise(1)
    w = Window.partitionBy(filing).orderBy("_p")
    cut = F.when((F.lag("_p").over(w) + 1 == F.col("_p")) & F.lag("value").over(w).eqNullSafe(F.col("value")), 0).otherwise(1)
    runs = v.withColumn("_c", cut).withColumn("_n", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(filing, "_n").agg(F.min("_p").alias("start"), F.max("_p").alias("end"), F.first("value").alias("value"))
    return out.select(filing, F.format_string("segment_%04d", F.col("_n")).alias("segment_id"), "start", "end", "value")


def dominant_label(df: DataFrame, filing: str, label: str) -> DataFrame:
    """Rows ``(filing, label, n)``: the label on most pages, of equally many the larger one."""
    n = df.where(F.col(label).isNotNull()).groupBy(filing, label).agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(filing).orderBy(F.desc("n"), F.desc(label)))).where("_r = 1").drop("_r")


def even_gap_split(df: DataFrame, keys: Sequence[str], order: str, marks: int) -> DataFrame:
    """``df`` with ``mark``: the rows of a key split evenly over 1..marks, the remainder to the first."""
    return df.withColumn("mark", F.ntile(marks).over(Window.partitionBy(*keys).orderBy(order)))


def family_counters(df: DataFrame, filing: str, page: str, opens: Column) -> DataFrame:
    """``df`` with ``family_no``: a counter going up at each opening page; null in filings with fewer than two."""
    w = Window.partitionBy(filing)
    n = F.sum(opens.cast("int"))
    return df.withColumn("family_no", F.when(n.over(w) >= 2, n.over(w.orderBy(page).rowsBetween(Window.unboundedPreceding, 0))))


def source_order_numbers(df: DataFrame, filing: str, family: str, start: str) -> DataFrame:
    """``df`` with ``number``: a family's members numbered by first page."""
    return df.withColumn("number", F.dense_rank().over(Window.partitionBy(filing, family).orderBy(start)))


def page_windows(df: DataFrame, filing: str, page: str, first: int, last: int) -> DataFrame:
    """The ``first`` first and ``last`` last pages of each filing."""
    w = Window.partitionBy(filing)
    a, b = F.row_number().over(w.orderBy(page)), F.row_number().over(w.orderBy(F.desc(page)))
    return df.withColumn("_a", a).withColumn("_b", b).where((F.col("_a") <= first) | (F.col("_b") <= last)).drop("_a", "_b")
