"""Relational building blocks: guards, lookups, differences, hierarchies, comparisons, sorts, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_guard(listed: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row ``(missing, keys)``: how many listed keys the target lacks, and their ordered list."""
    gone = listed.select(key).where(F.col(key).isNotNull()).distinct().join(target.select(key).distinct(), key, "left_anti")
    return gone.agg(F.count("*").alias("missing"), F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ", ").alias("keys"))


def checked(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """``df``; reading a row for which ``holds`` isn't true fails with the message (U3, guards)."""
    return df.where(F.when(holds, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` without rows whose keys ``gone`` has: delete by join."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def versioned(df: DataFrame, touched: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``df`` with ``version`` one higher where ``touched`` has the keys: update by join."""
    hit = touched.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, list(keys), "left").withColumn(version, F.col(version) + F.coalesce(F.col("_hit").cast("int"), F.lit(0))).drop("_hit")


def with_lookup(df: DataFrame, look: DataFrame, key: str, column: str, default=None) -> DataFrame:
    """``df`` with ``column`` looked up by key, unmatched rows kept; a column that is there already stays."""
    if column in df.columns:
        return df
    one = look.groupBy(key).agg(F.max(column).alias(column))
    out = df.join(one, key, "left")
    return out if default is None else out.withColumn(column, F.coalesce(column, F.lit(default)))


def two_way_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ``(*keys, side)``: keys of ``a`` only (``left``) and of ``b`` only (``right``)."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("right")))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, of equals the new one (K1, K4)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new")))).where("_n = 1").drop("_n", "_new")


def hierarchy(df: DataFrame, ident: str, parent: str) -> DataFrame:
    """Rows ``(ident, root, level, path)`` of a forest; a parent that isn't there makes its child a root.

    ``path`` sorts parents before children. One equi-join per level, up to the
    first level without rows; members of a cycle have no root and give no row.
    """
    nodes = df.select(F.col(ident).cast("string").alias("_i"), F.col(parent).cast("string").alias("_p")).distinct()
    level = nodes.join(nodes.select(F.col("_i").alias("_p")), "_p", "left_anti").unionByName(nodes.where("_p is null")).select("_i", F.col("_i").alias("root"), F.lit(0).alias("level"), F.array("_i").alias("path")).distinct()
    out, last, n = level, level, 0
    while True:
        n += 1
        last = nodes.join(last.select(F.col("_i").alias("_p"), "root", "path"), "_p").select("_i", "root", F.lit(n).alias("level"), F.concat("path", F.array("_i")).alias("path"))
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out.select(F.col("_i").alias(ident), "root", "level", "path")


def compared(expected: DataFrame, actual: DataFrame, key: str, value: str, missing: str = "missing") -> DataFrame:
    """Rows ``(key, expected, actual, passed)`` over the keys of both sides, a lacking one as ``missing``."""
    e = expected.select(key, F.coalesce(F.col(value).cast("string"), F.lit("null")).alias("expected"))
    a = actual.select(key, F.coalesce(F.col(value).cast("string"), F.lit("null")).alias("actual"))
    out = e.join(a, key, "full_outer").na.fill(missing, ["expected", "actual"])
    return out.withColumn("passed", F.col("expected") == F.col("actual"))


def code_key(code: str | Column) -> list[Column]:
    """Sort keys of codes such as D-2 < D-10 < D-10A; what isn't such a code is last (T5)."""
    c = F.col(code) if isinstance(code, str) else code
    number = F.regexp_extract(c, r"^[A-Za-z]+-?0*(\d+)([A-Za-z]?)$", 1)
    return [F.when(number == "", F.lit(10**9)).otherwise(number.try_cast("bigint")), F.upper(F.regexp_extract(c, r"^[A-Za-z]+-?0*(\d+)([A-Za-z]?)$", 2)), c]


def first_wins_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The rows of all parts, of one key those of the first part that has it, with ``source_ord`` (U8)."""
    every = None
    for n, p in enumerate(parts):
        p = p.withColumn("source_ord", F.lit(n))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("source_ord"))).where("_n = 1").drop("_n")


def suppressed_aliases(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``df`` without keys whose preferred key (``pairs``: alias, preferred) it has, too (U8)."""
    here = df.select(F.col(key).alias("preferred")).distinct()
    gone = pairs.join(here, "preferred", "left_semi").select(F.col("alias").alias(key))
    return df.join(gone, key, "left_anti")


def schema_union(parts: dict[str, DataFrame], discriminator: str) -> DataFrame:
    """All parts in one table with the name of each in ``discriminator``; columns a part lacks are null, columns of two types are text."""
    kinds: dict[str, set[str]] = {}
    for p in parts.values():
        for f in p.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    out = None
    for name, p in parts.items():
        p = p.select(*[F.col(c).cast("string").alias(c) if len(kinds[c]) > 1 else F.col(c) for c in p.columns], F.lit(name).alias(discriminator))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def fetched(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, one per key; missing keys are omitted."""
    return df.join(wanted.select(key).distinct(), key, "left_semi").dropDuplicates([key])


def flag_filter(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose first present flag column of ``columns`` is truthy; all rows if there is none (P5)."""
    for c in columns:
        if c in df.columns:
            return df.where(F.lower(F.trim(F.col(c).cast("string"))).isin("true", "t", "1", "yes", "y", "active", "enabled"))
    return df


def owner_of_missing(wanted: DataFrame, present: DataFrame, part: str, owner_order: Sequence[str | Column], owner: str) -> DataFrame:
    """Rows ``(part, owner)``: one owner of each wanted part that isn't present, the first by ``owner_order``."""
    gone = wanted.join(present.select(part).distinct(), part, "left_anti")
    return gone.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(*owner_order))).where("_n = 1").select(part, owner)


def exactly_once(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(key).isNull() | (F.col("_n") == 1)).drop("_n")
