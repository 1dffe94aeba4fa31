"""Retrieval: filtered top-k by similarity, cut-offs, quotas, budgets, fallbacks, reranking.

Queries are a table (``query_id``, a vector, filters). A stated query set is compared with
all rows of the corpus in blocks: the queries of a filter value meet the rows of that value
in an equi-join; ranks are cut by ``row_number() <= k``, which Spark limits per partition
before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays of numbers; null where one has length 0."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def top_k(queries: DataFrame, corpus: DataFrame, scope: Sequence[str], k: int, *, slices: int = 16, query: str = "query_id", vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """Rows ``(query_id, *scope, ident, score, rank)``: the ``k`` most similar rows within each query's scope.

    The scope columns are an equality filter before the ranking; of equal scores the
    smaller id is first; a row isn't found by itself. The corpus is cut into ``slices`` by a
    hash of its ids and every query meets each slice, so neither a hot scope nor no scope at
    all makes one large task; each task cuts to ``k`` before the ranks are shuffled.
    """
    q = queries.select(F.col(query), F.col(vector).alias("_qv"), *scope, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    c = corpus.select(F.col(ident), F.col(vector).alias("_v"), *scope, F.pmod(F.xxhash64(ident), F.lit(slices)).cast("int").alias("_slice"))
    scored = q.join(c, [*scope, "_slice"]).where(F.col(query) != F.col(ident)).select(query, *scope, ident, F.round(cosine("_qv", "_v"), 6).alias("score")).where("score is not null")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), ident))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def keep_nearby(hits: DataFrame, query: str, gap: float = 0.36, most: int = 8) -> DataFrame:
    """Hits whose score is within ``gap`` of the best by logarithm, ``most`` at most, in the order given.

    If none is left the first is kept; with a best score of 0 or less all are, up to ``most``.
    """
    w = Window.partitionBy(query)
    best = F.max("score").over(w)
    near = (best <= 0) | ((F.col("score") > 0) & (F.ln(best / F.when(F.col("score") > 0, F.col("score"))) <= gap))
    kept = hits.withColumn("_near", F.coalesce(near, F.lit(False))).withColumn("_any", F.max("_near").over(w))
    kept = kept.where("_near or (not _any and rank = 1)")
    return kept.withColumn("_n", F.row_number().over(w.orderBy("rank"))).where(F.col("_n") <= most).drop("_near", "_any", "_n")


def best_per_id(hits: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of several hits of one id the best, first of equals (U1, A11); with the source in ``order`` also last or first wins."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *order))).where("_n = 1").drop("_n")


def with_fallback(primary: DataFrame, fallback: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """The primary hits, and for queries without any those of the fallback."""
    empty = queries.select(query).distinct().join(primary.select(query).distinct(), query, "left_anti")
    return primary.unionByName(fallback.join(empty, query, "left_semi"))


def quota(hits: DataFrame, query: str, part: str, budget: int, ident: str) -> DataFrame:
    """Up to ``budget`` hits of a query, at least the best of each part first, the rest by rank."""
    w = Window.partitionBy(query)
    first = F.row_number().over(Window.partitionBy(query, part).orderBy("rank", ident)) == 1
    order = hits.withColumn("_first", first).withColumn("_o", F.row_number().over(w.orderBy(F.desc("_first"), "rank", ident)))
    return order.where(F.col("_o") <= budget).drop("_first", "_o")


def within_budget(hits: DataFrame, query: str, budget: Column, order: Sequence[Column | str]) -> DataFrame:
    """The first hits of each query, as many as its own budget column says (T4)."""
    return hits.withColumn("_b", budget).withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("_n") <= F.col("_b")).drop("_b", "_n")


def missing_parts(wanted: DataFrame, hits: DataFrame, query: str, part: str) -> DataFrame:
    """Rows ``(query, part)`` that are wanted and that no hit covers."""
    return wanted.select(query, part).distinct().join(hits.select(query, part).distinct(), [query, part], "left_anti")


def greedy_pages(pages: DataFrame, filing: str, page: str, essential: str, priority: str, share: float = 0.30, above: int = 20) -> DataFrame:
    """Essential pages first, then by priority; above ``above`` pages only ``max(essential, ceil(share * n))`` of them."""
    w = Window.partitionBy(filing)
    n, e = F.count("*").over(w), F.sum(F.col(essential).cast("int")).over(w)
    budget = F.when(n > above, F.greatest(e, F.ceil(n * share))).otherwise(n)
    ranked = pages.withColumn("_b", budget).withColumn("_r", F.row_number().over(w.orderBy(F.desc(essential), F.desc(priority), page)))
    return ranked.where(F.col("_r") <= F.col("_b")).drop("_b", "_r")


def batched(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``df`` with ``batch``: rows of a key in groups of ``size``."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def char_batches(df: DataFrame, key: str, order: Sequence[str], chars: str, budget: int = 60_000, overhead: int = 300) -> DataFrame:
    """``df`` with ``batch``: consecutive rows whose characters, and ``overhead`` each, stay within ``budget``.

    A fold over each key's sizes: a row that would pass the budget opens the next batch.
    """
    s = F.struct(*[F.col(o) for o in order], (F.least(F.coalesce(chars, F.lit(0)), F.lit(budget)) + overhead).cast("bigint").alias("_c"))
    folded = df.groupBy(key).agg(F.sort_array(F.collect_list(s)).alias("_rows"))
    step = lambda acc, x: F.struct(
        F.when((acc["used"] > 0) & (acc["used"] + x["_c"] > budget), x["_c"]).otherwise(acc["used"] + x["_c"]).alias("used"),
        F.when((acc["used"] > 0) & (acc["used"] + x["_c"] > budget), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
        F.concat(acc["out"], F.array(F.when((acc["used"] > 0) & (acc["used"] + x["_c"] > budget), acc["n"] + 1).otherwise(acc["n"]))).alias("out"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    out = folded.select(key, F.explode(F.arrays_zip("_rows", F.aggregate("_rows", start, step)["out"].alias("batch"))).alias("_z"))
    return out.select(key, *[F.col(f"_z._rows.{o}").alias(o) for o in order], F.col("_z.batch").alias("batch"))


def lexical_scores(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """``df`` with ``term_hits``: how many of the terms the text holds, case aside (J12, E3's plain scorer)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return df.withColumn("term_hits", sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)))


def reranked(hits: DataFrame, scores: DataFrame, query: str, ident: str, most: int = 60) -> DataFrame:
    """``hits`` with ``rerank``: the first ``most`` in order of a score table, those without a score behind them; the rest keep their place."""
    scored = hits.join(scores.select(query, ident, F.col("score").alias("_s")), [query, ident], "left").withColumn("_s", F.when(F.col("rank") <= most, F.col("_s")))
    order = [F.col("rank") > most, F.desc_nulls_last("_s"), F.col("rank")]
    return scored.withColumn("rerank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).drop("_s")


def retrieval_plans(checks: DataFrame, check: str, text: str, parts: str, excluded: str, first: str, phrases: str, heading: str, subtype: str, *, family: str = "application", most: int = 4) -> DataFrame:
    """Rows ``(check, place, query_text, part, subtype, purpose)``: the searches of each check, ``most`` of them.

    A check looks in its ``parts`` that aren't ``excluded``, those it depends on (``first``) before the others; without parts
    anywhere, and under its ``heading``. A search is the text and the distinct phrases; the subtype narrows searches in the
    ``family`` only. Of searches with the same text (white space and case aside), part and subtype the first is kept. Null arrays are empty ones.
    """
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    wanted = F.array_except(F.array_distinct(array(parts)), array(excluded))
    targets = F.slice(F.array_distinct(F.concat(F.array_intersect(array(first), wanted), wanted)), 1, most)
    base = checks.select(F.col(check), F.col(text).alias("_x"), F.array_distinct(array(phrases)).alias("_ph"), F.col(heading).alias("_h"), F.col(subtype).alias("_sub"), targets.alias("_t"), wanted.alias("_w"))
    none = F.size("_w") == 0
    struct = lambda part, why, own: F.struct(part.alias("part"), why.alias("purpose"), own.alias("text"))
    null = F.lit(None).cast("string")
    purpose = F.when(F.size("_ph") > 0, F.lit("semantic_and_exact")).otherwise(F.lit("semantic"))
    words = F.concat_ws(" ", F.col("_x"), F.array_join("_ph", " "))
    plain = F.when(none, F.array(struct(null, purpose, words))).otherwise(F.transform("_t", lambda p: struct(p, purpose, F.concat_ws(" ", F.concat(p, F.lit(":")), words))))
    more = F.when(none & (F.trim("_h") != ""), F.array(struct(null, F.lit("heading"), F.concat_ws(" ", F.col("_h"), F.col("_x")))))
    rows = base.select(check, "_sub", F.posexplode(F.concat(plain, F.coalesce(more, F.array().cast(plain_type()))).alias("_q")).alias("_at", "_q"))
    flat = rows.select(check, "_at", F.trim(F.col("_q.text")).alias("query_text"), F.col("_q.part").alias("part"), F.when(F.col("_q.part") == family, F.col("_sub")).alias("subtype"), F.col("_q.purpose").alias("purpose"))
    same = Window.partitionBy(check, F.lower(F.regexp_replace("query_text", r"\s+", " ")), "part", "subtype").orderBy("_at")
    kept = flat.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return kept.select(check, F.row_number().over(Window.partitionBy(check).orderBy("_at")).cast("int").alias("place"), "query_text", "part", "subtype", "purpose")


def plain_type() -> str:
    """The type of a search before it is laid out."""
    return "array<struct<part:string,purpose:string,text:string>>"


def uncovered_pages(wanted: DataFrame, pages: DataFrame, hits: DataFrame, check: str, filing: str, part: str) -> DataFrame:
    """Rows ``(check, filing, part, page, ...)``: pages of the parts a check wants whole that no hit shows.

    ``wanted`` has ``check, part``, ``pages`` ``filing, part, page`` and what else a page has, ``hits`` ``check, filing, page``. An equi-join on the part, not
    on all pages.
    """
    return pages.join(wanted.select(check, part).distinct(), part).join(hits.select(check, filing, "page").distinct(), [check, filing, "page"], "left_anti")


def layout_fallback(hits: DataFrame, pages: DataFrame, anchors: DataFrame, check: str, filing: str, text: str, most: int) -> DataFrame:
    """Rows ``(check, filing, page, origin, score)``: a check's hits, and behind them pages that hold its anchor phrases, ``most`` in all.

    ``hits`` has ``check, filing, page, score``, ``anchors`` ``check, phrase``, ``pages`` ``filing, page`` and the text, of filings that have hits. A page's score is
    the number of phrases it holds, case and white space aside; pages already hit, and pages without a phrase, add nothing.
    """
    fold = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    one = hits.groupBy(check, filing, "page").agg(F.max("score").alias("score"))
    own = anchors.where(F.trim("phrase") != "").groupBy(check).agg(F.collect_set(fold(F.col("phrase"))).alias("_ph"))
    asked = one.select(check, filing).distinct().join(own, check)
    near = asked.join(pages.select(filing, "page", fold(F.coalesce(text, F.lit(""))).alias("_x")), filing).withColumn("score", F.size(F.filter("_ph", lambda p: F.contains("_x", p))).cast("double")).where("score > 0")
    new = near.select(check, filing, "page", "score").join(one.select(check, filing, "page"), [check, filing, "page"], "left_anti").withColumn("origin", F.lit("layout"))
    every = one.withColumn("origin", F.lit("search")).unionByName(new)
    place = F.row_number().over(Window.partitionBy(check, filing).orderBy(F.col("origin") == "layout", F.desc("score"), "page"))
    return every.withColumn("_n", place).where(F.col("_n") <= most).select(check, filing, "page", "origin", "score")


def followed_up(hits: DataFrame, shown: DataFrame, parts: DataFrame, query: str, ident: str, part: str, keep: int) -> DataFrame:
    """The first ``keep`` hits of a second search: of the best ``max(2 * keep, 6)`` in the wanted parts those not shown before."""
    w = Window.partitionBy(query).orderBy("rank", ident)
    pool = hits.join(parts.select(query, part).distinct(), [query, part], "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(2 * keep, 6)).drop("_n")
    fresh = pool.join(shown.select(query, ident), [query, ident], "left_anti")
    return fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
