"""Continuous periods and gaps of overlapping page or value ranges, by sweep line.

Every range becomes a plus event at its start and a minus event behind its end.
Events are summed per position before anything is shuffled, so a position that a
million ranges share is one row. Prefix sums run at two levels: inside a block of
``block`` positions, and over the totals of the blocks. One entity that holds a
third of all rows is therefore spread over its blocks, and no window ever holds
more than ``block`` rows, or one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def periods_and_gaps(
    ranges: DataFrame,
    keys: Sequence[str],
    start: str | Column,
    end: str | Column,
    bounds: DataFrame | None = None,
    block: int = 4096,
) -> DataFrame:
    """Rows ``(*keys, kind, start, end)``: each continuous ``period`` and each ``gap`` between two.

    Ranges are inclusive whole numbers; ranges that share or adjoin a value are one
    period. A range with a null endpoint, a start below 1 or a start after its end
    is ignored. With ``bounds`` (``*keys, upper``; one row per entity counts, the
    largest ``upper``) gaps are cut to 1..upper, the stretch before the first and
    behind the last period counts, and so does an entity without a valid range.

    Defined cases: null keys form an entity of their own; repeated rows, ties and
    nested ranges change nothing; an empty table gives no rows; other columns of
    ``ranges``, whatever their names, are not looked at.
    """
    keys = list(keys)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    k = [f"_k{i}" for i in range(len(keys))]
    rows = ranges.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], as_col(start).cast("bigint").alias("_s"), as_col(end).cast("bigint").alias("_e"))
    rows = rows.where("_s is not null and _e is not null and _s >= 1 and _s <= _e")
    events = (
        rows.select(*k, F.explode(F.array(F.struct(F.col("_s").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("_e") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("ev"))
        .select(*k, F.col("ev.pos").alias("_pos"), F.col("ev.d").alias("_d"))
        .groupBy(*k, "_pos")
        .agg(F.sum("_d").alias("_d"))
        .where("_d <> 0")
        .withColumn("_b", F.floor(F.col("_pos") / block))
    )
    totals = events.groupBy(*k, "_b").agg(F.sum("_d").alias("_bd"))
    by_entity = Window.partitionBy(*k).orderBy("_b")
    before = totals.select(*[F.col(c).alias(f"{c}t") for c in k], F.col("_b").alias("_bt"), (F.sum("_bd").over(by_entity) - F.col("_bd")).alias("_base"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}t")) for c in k] + [F.col("_b") == F.col("_bt")]
    by_block = Window.partitionBy(*k, "_b").orderBy("_pos")
    active = events.join(before, same).select(*k, "_b", "_pos", "_d", (F.col("_base") + F.sum("_d").over(by_block)).alias("_n"))
    # a boundary opens or closes coverage; the count before it needs no look back
    edges = active.where("(_n > 0) <> (_n - _d > 0)").select(*k, "_b", "_pos", (F.col("_n") > 0).alias("_open"))
    firsts = edges.groupBy(*k, "_b").agg(F.min("_pos").alias("_first"))
    following = firsts.select(*[F.col(c).alias(f"{c}t") for c in k], F.col("_b").alias("_bt"), F.lead("_first").over(by_entity).alias("_later"))
    stretch = (
        edges.join(following, same)
        .select(*k, "_open", F.col("_pos").alias("_s"), (F.coalesce(F.lead("_pos").over(by_block), F.col("_later")) - 1).alias("_e"))
        .select(*k, F.when(F.col("_open"), "period").otherwise("gap").alias("kind"), "_s", "_e")
    )
    if bounds is None:
        out = stretch.where("_e is not null")
        return out.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], "kind", F.col("_s").alias("start"), F.col("_e").alias("end"))
    upper = bounds.select(*[F.col(c).alias(f"{a}u") for c, a in zip(keys, k)], F.col("upper").cast("bigint").alias("_up")).groupBy(*[f"{a}u" for a in k]).agg(F.max("_up").alias("_up"))
    match = [F.col(c).eqNullSafe(F.col(f"{c}u")) for c in k]
    inner = (
        stretch.join(upper, match, "left")
        .withColumn("_e", F.when(F.col("kind") == "gap", F.least(F.coalesce(F.col("_e"), F.col("_up")), F.col("_up"))).otherwise(F.col("_e")))
        .where("_e is not null and _s <= _e")
        .select(*k, "kind", "_s", "_e")
    )
    begin = edges.groupBy(*k).agg(F.min("_pos").alias("_p"))
    head = (
        upper.join(begin, match, "left")
        .select(*[F.col(f"{a}u").alias(a) for a in k], F.lit("gap").alias("kind"), F.lit(1).cast("bigint").alias("_s"), F.least(F.coalesce(F.col("_p") - 1, F.col("_up")), F.col("_up")).alias("_e"))
        .where("_s <= _e")
    )
    out = inner.unionByName(head)
    return out.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], "kind", F.col("_s").alias("start"), F.col("_e").alias("end"))


def page_periods(annotations: DataFrame, filing_parts: DataFrame) -> DataFrame:
    """Periods and gaps of cases (``annotations``) and filings (all ``page_span`` entries of their parts)."""
    a = periods_and_gaps(annotations, ["case_id"], "start_page", "end_page", annotations.select("case_id", F.col("page_count").alias("upper")))
    spans = filing_parts.select("filing_id", F.explode("page_span").alias("_span"))
    f = periods_and_gaps(spans, ["filing_id"], F.col("_span.start"), F.col("_span.end"))
    head = lambda df, origin, key: df.select(F.lit(origin).alias("origin"), F.col(key).alias("entity_id"), "kind", F.col("start").alias("start_page"), F.col("end").alias("end_page"))
    return head(a, "annotations", "case_id").unionByName(head(f, "filing_parts", "filing_id"))
