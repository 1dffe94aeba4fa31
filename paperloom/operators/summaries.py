"""Summaries: counts and shares, ordered text, decisive values, box extents, null-aware roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_3(value: str) -> Column:
    """The mean to 3 places, half to even, 0.0 if there is none; summed in millionths, so that ties are ties in any order of rows."""
    millionths = F.sum(F.round(F.col(value) * 1_000_000).cast("bigint"))
    return F.coalesce(F.bround(millionths / (F.count(value) * 1000), 0) / 1000, F.lit(0.0))


def status_summary(df: DataFrame, keys: Sequence[str], status: str, values: Sequence[str], confidence: str) -> DataFrame:
    """Per key a count of each status, all rows, and the mean confidence to 3 places, 0.0 if there is none."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values]
    return df.groupBy(*keys).agg(*counts, F.count("*").alias("total"), mean_3(confidence).alias("mean_confidence"))


def usage_shares(df: DataFrame, key: str, tokens: str, cost: str) -> DataFrame:
    """Per key tokens, cost (null where nothing was billed), share of the total (of cost, else of tokens) and rank."""
    per = df.groupBy(key).agg(F.sum(tokens).alias("tokens"), F.bround(F.sum(cost), 6).alias("cost"))
    w = Window.partitionBy()
    total_cost, total_tokens = F.sum("cost").over(w), F.sum("tokens").over(w)
    share = F.when(total_cost > 0, F.coalesce("cost", F.lit(0.0)) / total_cost).otherwise(F.try_divide(F.col("tokens"), total_tokens))
    rank = F.row_number().over(Window.orderBy(F.desc(F.coalesce("cost", F.lit(-1.0))), F.desc("tokens"), key))
    return per.select(key, "tokens", "cost", F.bround(share, 4).alias("share"), rank.alias("rank"))


def even_shares(df: DataFrame, key: str, member: str, total: str) -> DataFrame:
    """Rows ``(key, member, share)``: a whole number split evenly over a key's members, the remainder to the first (A4)."""
    w = Window.partitionBy(key)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(member))
    t = F.max(total).over(w)
    return df.select(key, member, (F.floor(t / n) + F.when(r <= t % n, 1).otherwise(0)).cast("bigint").alias("share"))


def decisive(df: DataFrame, keys: Sequence[str], status: str, confidence: str, bad: str, good: str, void: str, unclear: str) -> DataFrame:
    """Per key one status: ``bad`` if any is, ``good`` if all are, ``void`` if all are, else ``unclear``; and the most confident row's status."""
    every = lambda v: F.bool_and(F.coalesce(F.col(status) == v, F.lit(False)))
    some = F.bool_or(F.coalesce(F.col(status) == bad, F.lit(False)))
    top = F.max_by(F.col(status), F.struct(F.coalesce(confidence, F.lit(-1.0)), F.coalesce(status, F.lit(""))))
    return df.groupBy(*keys).agg(F.when(some, bad).when(every(good), good).when(every(void), void).otherwise(unclear).alias("decision"), top.alias("most_confident"))


def billing(df: DataFrame, product: str, job: str, credits: str, order: str, rate: float) -> DataFrame:
    """Per product jobs, billed and pending jobs, credits and their price (A3).

    Of several rows of one job the first with credits counts, else the first; rows without a
    job all count. Nothing billed gives a null price.
    """
    w = Window.partitionBy(product, job).orderBy(F.col(credits).isNull(), order)
    one = df.withColumn("_n", F.row_number().over(w)).where(F.col(job).isNull() | (F.col("_n") == 1))
    return one.groupBy(product).agg(F.count("*").alias("jobs"), F.count(credits).alias("billed"), F.count_if(F.col(credits).isNull()).alias("pending"), F.bround(F.sum(credits), 4).alias("credits"), F.bround(F.sum(credits) * rate, 6).alias("price"))


def distinct_in_order(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Per key the distinct values, in order of their first appearance."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def box_union(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str, h: str) -> DataFrame:
    """Per key the box around all boxes."""
    far = lambda a, b: F.max(F.col(a) + F.col(b))
    return df.groupBy(*keys).agg(F.min(x).alias("x"), F.min(y).alias("y"), F.bround(far(x, w) - F.min(x), 6).alias("w"), F.bround(far(y, h) - F.min(y), 6).alias("h"))


def median_gap(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key the median of the positive gaps between neighbours."""
    gap = df.withColumn("_g", F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order))).where("_g > 0")
    return gap.groupBy(*keys).agg(F.percentile("_g", 0.5).alias("median_gap"))


def dominant(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key the most frequent value, of equally frequent ones the smaller, and its count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))).where("_r = 1").drop("_r")


def list_hash(df: DataFrame, keys: Sequence[str], values: Column) -> DataFrame:
    """Per key the sha-256 of its sorted values as JSON."""
    return df.groupBy(*keys).agg(F.sha2(F.to_json(F.sort_array(F.collect_set(values))), 256).alias("list_hash"))


def duplicates(df: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Keys that several distinct ids have, and how many (A10)."""
    return df.groupBy(*keys).agg(F.count_distinct(ident).alias("n")).where("n > 1")


def micro_metrics(df: DataFrame, keys: Sequence[str], hit: str, predicted: str, expected: str) -> DataFrame:
    """Per key precision, recall and F1 as ratios of sums, null where the denominator is 0 (A5, M1)."""
    s = df.groupBy(*keys).agg(F.sum(hit).alias("hits"), F.sum(predicted).alias("predicted"), F.sum(expected).alias("expected"))
    p, r = F.try_divide("hits", "predicted"), F.try_divide("hits", "expected")
    f = F.when(p.isNull() & r.isNull(), F.lit(None)).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return s.select(*keys, "hits", "predicted", "expected", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(f, 6).alias("f1"))


def running_max(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``progress``: the highest value so far."""
    return df.withColumn("progress", F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
