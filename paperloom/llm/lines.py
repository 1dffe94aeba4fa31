"""Lines repeated across the documents of one source.

Copies of a document collapse first: a document is a cluster named by its own id
(rows repeated under one id count once) or, with ``cluster_by="text"``, by its text,
so that articles published again under other ids count once as well. Each line key is
then counted over distinct clusters and over distinct dates within its source.

Only 64-bit hashes of (source, line key, cluster) travel; the texts stay where they
are read. Counts are combined in two steps (distinct clusters per line, then their
number), so neither a hot source nor a hot line is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any kind, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


#: The same without line ends: runs of two or more, and single ones other than a plain blank.
LOOSE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000&&[^\n]]{2,}|[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000&&[^\n ]]"


def keyed_text(text: Column) -> Column:
    """A text whose lines, trimmed, are the keys: lower case, each run of white space one blank, each run of digits 0-9 one ``0``.

    Done on the whole text, as a call for each line costs more than the line.
    """
    return F.regexp_replace(F.regexp_replace(F.lower(text), LOOSE, " "), "[0-9]+", "0")


def _prepared(df: DataFrame, source: str, doc_id: str, text: str, date: str | None, cluster_by: str) -> DataFrame:
    cluster = F.xxhash64(F.col(doc_id)) if cluster_by == "id" else F.xxhash64(F.regexp_replace(F.trim(F.col(text)), SPACE, " "))
    day = F.lit(None).cast("date") if date is None else F.to_date(F.col(date))
    return df.select(F.xxhash64(F.col(source)).alias("_s"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"), cluster.alias("_c"), day.alias("_day")).where(F.col("_text").rlike(r"\S"))


def _keyed_lines(docs: DataFrame, min_letters: int) -> DataFrame:
    lines = docs.select("_s", "_id", "_c", "_day", F.posexplode(F.split(keyed_text(F.col("_text")), "\n")).alias("_at", "_line"))
    keyed = lines.where(F.length("_line") >= min_letters).withColumn("_key", F.trim("_line"))
    return keyed.where(F.col("_key").rlike("(?:[^a-z]*+[a-z]){%d}" % min_letters)).select("_s", "_id", "_c", "_day", (F.col("_at") + 1).cast("bigint").alias("_no"), F.xxhash64("_key").alias("_k"))


def excessive_lines(df: DataFrame, source: str, doc_id: str, text: str, date: str | None = None, *, cluster_by: str = "id", min_docs: int = 10, min_repeats: int = 5, min_share: float = 0.1, min_dates: int = 1, min_letters: int = 12) -> DataFrame:
    """Rows ``(_s, _k, n_docs, n_dates, of_docs)``: the line keys repeated excessively in a source, both as hashes.

    A source counts from ``min_docs`` distinct non-blank documents; a key is excessive
    from ``min_repeats`` of them, ``min_share`` of them and ``min_dates`` dates. Keys
    with fewer than ``min_letters`` letters a-z never count. Null or blank texts count
    as no document; a null source is a source of its own; an empty table gives no rows.
    """
    docs = _prepared(df, source, doc_id, text, date, cluster_by)
    sizes = docs.select("_s", "_c").distinct().groupBy("_s").agg(F.count("*").alias("of_docs")).where(F.col("of_docs") >= min_docs)
    per_cluster = _keyed_lines(docs, min_letters).groupBy("_s", "_k", "_c").agg(F.min("_day").alias("_day"))
    counted = per_cluster.groupBy("_s", "_k", "_day").agg(F.count("*").alias("n")).groupBy("_s", "_k").agg(F.sum("n").alias("n_docs"), F.greatest(F.count("_day"), F.lit(1)).alias("n_dates")).where(F.col("n_docs") >= min_repeats)
    return counted.join(sizes, "_s").where((F.col("n_docs") >= F.col("of_docs") * min_share) & (F.col("n_dates") >= min_dates))


def repeated_lines(df: DataFrame, source: str, doc_id: str, text: str, date: str | None = None, **limits) -> DataFrame:
    """Rows ``(doc_id, line_no)``: each line, counted from 1, whose key is excessive in its document's source.

    Rows repeated under one id give each line once. ``limits`` as in
    :func:`excessive_lines`.
    """
    found = excessive_lines(df, source, doc_id, text, date, **limits).select("_s", "_k")
    docs = _prepared(df, source, doc_id, text, None, limits.get("cluster_by", "id"))
    hits = _keyed_lines(docs, limits.get("min_letters", 12)).select("_s", "_k", "_id", "_no").join(found, ["_s", "_k"])
    return hits.select(F.col("_id").alias(doc_id), F.col("_no").alias("line_no")).distinct()


def without_repeated_lines(df: DataFrame, source: str, doc_id: str, text: str, date: str | None = None, **limits) -> DataFrame:
    """``df`` without the excessive lines of each text, one row per document id.

    Adds ``removed_lines`` (how many went). A text all of whose lines go becomes empty;
    null and blank texts stay as they are; the rows repeated under one id collapse.
    """
    gone = repeated_lines(df, source, doc_id, text, date, **limits).groupBy(doc_id).agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed(doc_id, "_gone_id")
    one = df.select(F.col(source).alias("_o_src"), F.col(doc_id).alias("_o_id"), F.col(text).alias("_o_text")).dropDuplicates(["_o_id"])
    joined = one.join(gone, F.col("_o_id") == F.col("_gone_id"), "left")
    kept = F.filter(F.split("_o_text", "\n"), lambda x, i: ~F.array_contains(F.coalesce(F.col("_gone"), F.array().cast("array<bigint>")), (i + 1).cast("bigint")))
    cleaned = F.when(F.col("_gone").isNull(), F.col("_o_text")).otherwise(F.concat_ws("\n", kept))
    return joined.select(F.col("_o_src").alias(source), F.col("_o_id").alias(doc_id), cleaned.alias(text), F.coalesce(F.size("_gone"), F.lit(0)).alias("removed_lines"))
