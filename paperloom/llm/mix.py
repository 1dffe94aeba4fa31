"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (a hash of id, seed and round; the
order of every repeat is another). A document's virtual finish time is the cumulative
size of its source up to and with it, over the source's weight. All copies of all
sources, in order of finish time, are the mix; it ends where the total budget does.

Both prefix sums - within a source, and over the whole mix - run at two levels, over
blocks of the order and inside each block, so that no source, however large, and no
total order stands in one task. The blocks follow from the counts of documents; copies that
stand behind the budget for certain are left out before they are made, numbered or sorted.
The counts of the sources that have a target, a row each, are all that comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a source's order at least, and the documents of a block where there are more.
BLOCKS, PER_BLOCK = 256, 20_000


def surely_full(sources: list[tuple[float, int, int]], budget: float) -> float:
    """The virtual time by which copies up to the budget have been served whatever their sizes; infinite if there aren't so many.

    ``sources`` has weight, size of all copies and size of the largest document: at a time t a source
    has served all it has, or weight times t but for the copy it is at.
    """
    if sum(all_of for _, all_of, _ in sources) <= budget:
        return math.inf
    served = lambda t: sum(all_of if w * t >= all_of else max(0.0, w * t - most) for w, all_of, most in sources)
    low, high = 0.0, max(all_of / w for w, all_of, _ in sources) * (1 + 1e-9)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if served(middle) > budget else (middle, high)
    return high


def before_each(df: DataFrame, keys: list[str], place: str, size: str, width: int) -> DataFrame:
    """Rows ``(*keys, place, _before)``: the sum of the sizes at earlier places of the keys, over groups of ``width`` places and inside each."""
    grouped = df.select(*keys, place, size, F.floor(F.col(place) / width).cast("bigint").alias("_group"))
    sums = grouped.groupBy(*keys, "_group").agg(F.sum(size).alias("_gs"))
    head = sums.select(*keys, "_group", (F.sum("_gs").over(Window.partitionBy(*keys).orderBy("_group")) - F.col("_gs")).alias("_head"))
    inside = Window.partitionBy(*keys, "_group").orderBy(place)
    return grouped.join(head, [*keys, "_group"]).select(*keys, place, (F.col("_head") + F.sum(size).over(inside) - F.col(size)).alias("_before"))


def fair_mix(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, size: str, *, weight: str = "target_weight", repeats: str = "max_repeats", total: int | None = None, seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """Rows ``(doc_id, source, repeat_no, size, finish, mix_position_size)``: the mix, each copy a row.

    Without ``total`` the budget is the most that every source can fill to its share: the
    least, over the sources that have both documents and a target, of size times repeats
    over weight, times the sum of these weights. With a larger ``total`` sources run out
    and the others go on; :func:`mix_report` has the shares reached. The copy that
    would pass the budget is the first left out.

    Sources without a target, targets without documents, documents of size 0 or null and
    targets with null or non-positive weight or repeats take no part. Repeated target rows
    count once (the largest weight), repeated document ids once. Empty tables give no rows.
    """
    t = targets.select(F.col(source).alias("_src"), F.col(weight).cast("double").alias("_w"), F.col(repeats).cast("int").alias("_r")).where("_src is not null and _w > 0 and _r > 0 and not isnan(_w)").groupBy("_src").agg(F.max("_w").alias("_w"), F.max("_r").alias("_r"))
    d = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_src"), F.col(size).cast("bigint").alias("_n")).where("_id is not null and _n > 0").groupBy("_id").agg(F.min("_src").alias("_src"), F.max("_n").alias("_n"))
    supply = d.groupBy("_src").agg(F.sum("_n").alias("_have"), F.max("_n").alias("_most"), F.count("*").alias("_docs"))
    rows = t.join(supply, "_src").collect()
    weights = sum(r["_w"] for r in rows)
    budget = float(total) if total is not None else math.floor(min((r["_have"] * r["_r"] / r["_w"] for r in rows), default=0.0) * weights + 1e-6)
    until = surely_full([(r["_w"], r["_have"] * r["_r"], r["_most"]) for r in rows], budget)
    bits = max(8, math.ceil(math.log2(max([blocks, *(r["_docs"] / PER_BLOCK for r in rows)]))))
    made = sum(r["_docs"] * min(r["_r"], until * r["_w"] / r["_have"] + 1) for r in rows)
    slots = max(blocks * 4, int(made / PER_BLOCK))
    plan = docs.sparkSession.createDataFrame([(r["_src"], r["_w"], r["_have"], int(min(r["_r"], until * r["_w"] // r["_have"] + 1))) for r in rows], t.select("_src").schema.add("_w", "double").add("_have", "long").add("_use", "integer"))
    copies = d.join(plan, "_src").select("_id", "_src", "_n", "_w", "_have", F.explode(F.sequence(F.lit(1), F.col("_use"))).alias("_rep"))
    shuffled = copies.withColumn("_h", F.xxhash64("_id", "_rep", F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits)).withColumn("_h", F.shiftleft("_h", bits))
    per_block = shuffled.groupBy("_src", "_rep", "_b").agg(F.sum("_n").alias("_bn"))
    earlier = before_each(per_block, ["_src", "_rep"], "_b", "_bn", 1 << (bits + 1) // 2).withColumnRenamed("_before", "_base")
    inside = Window.partitionBy("_src", "_rep", "_b").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0)
    early = shuffled.join(earlier, ["_src", "_rep", "_b"]).withColumn("_base", (F.col("_rep") - 1) * F.col("_have") + F.col("_base")).where(F.col("_base") / F.col("_w") <= F.lit(until))
    timed = early.select("_id", "_src", "_rep", "_n", (F.col("_base") + F.sum("_n").over(inside)).alias("_cum"), "_w").withColumn("_f", F.col("_cum") / F.col("_w")).where(F.col("_f") <= F.lit(until))
    # slots of the virtual time, which fill evenly, as all sources are served in step
    last = until if math.isfinite(until) else max((r["_have"] * r["_r"] / r["_w"] for r in rows), default=1.0)
    ranged = timed.withColumn("_slot", F.floor(F.col("_f") / F.lit(last or 1.0) * slots).cast("bigint"))
    per_slot = ranged.groupBy("_slot").agg(F.sum("_n").alias("_sn"))
    before = before_each(per_slot, [], "_slot", "_sn", math.isqrt(slots) + 1).where(F.col("_before") <= F.lit(budget))
    in_slot = Window.partitionBy("_slot").orderBy("_f", "_src", "_rep", "_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(before, "_slot").withColumn("_upto", F.col("_before") + F.sum("_n").over(in_slot)).where(F.col("_upto") <= F.lit(budget))
    return placed.select(F.col("_id").alias(doc_id), F.col("_src").alias(source), F.col("_rep").alias("repeat_no"), F.col("_n").alias(size), F.col("_f").alias("finish"), F.col("_upto").alias("mix_position_size"))


def mix_report(mix: DataFrame, targets: DataFrame, source: str, size: str, *, weight: str = "target_weight") -> DataFrame:
    """Rows ``(source, target_share, copies, documents, size, share, max_repeat)``: the shares reached.

    ``target_share`` is over all targets, those without documents too; such a source has
    size 0.
    """
    t = targets.select(F.col(source).alias("_src"), F.col(weight).cast("double").alias("_w")).where("_src is not null and _w > 0").groupBy("_src").agg(F.max("_w").alias("_w"))
    got = mix.groupBy(F.col(source).alias("_src")).agg(F.count("*").alias("copies"), F.count_if(F.col("repeat_no") == 1).alias("documents"), F.sum(size).alias("_n"), F.max("repeat_no").alias("max_repeat"))
    whole = Window.partitionBy()
    return t.join(got, "_src", "left").select(
        F.col("_src").alias(source),
        (F.col("_w") / F.sum("_w").over(whole)).alias("target_share"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("_n", F.lit(0)).alias(size),
        F.try_divide(F.coalesce("_n", F.lit(0)), F.sum("_n").over(whole)).alias("share"),
        F.coalesce("max_repeat", F.lit(0)).alias("max_repeat"),
    )
