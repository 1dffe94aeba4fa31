"""Queries of retrieval over the embeddings (label: the part) and the chunks."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import retrieval as R
from ..session import table

SIM = """q AS (SELECT vec_id AS query_id, embedding AS qv, label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.label, e.vec_id, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(qv AS DOUBLE[]), CAST(qv AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS score FROM q JOIN embeddings e ON {on} WHERE q.query_id <> e.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {k})"""
IN = SIM.format(on="q.label = e.label", k=8)
ALL = SIM.format(on="true", k=24)


def corpus(spark, d):
    return table(spark, d, "embeddings")


def asked(spark, d):
    """The stated query set: every row whose id is divisible by 100."""
    return corpus(spark, d).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


def scoped(spark, d, k=8):
    return R.top_k(asked(spark, d), corpus(spark, d), ["label"], k)


def unscoped(spark, d, k=24):
    hits = R.top_k(asked(spark, d).drop("label"), corpus(spark, d).drop("label"), [], k)
    return hits.join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("query_id", "label", "vec_id", "score", "rank")


@query("topk_scoped_similarity", f"WITH {IN} SELECT * FROM t")
def topk_scoped_similarity(spark, d):
    return scoped(spark, d)


@query("topk_similarity", f"WITH {ALL} SELECT * FROM t")
def topk_similarity(spark, d):
    return unscoped(spark, d)


GAP = "g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM t), h AS (SELECT *, coalesce(best <= 0 OR (score > 0 AND ln(best / CASE WHEN score > 0 THEN score END) <= 0.36), false) AS near FROM g), i AS (SELECT *, max(near) OVER (PARTITION BY query_id) AS anyone FROM h)"


@query("topk_log_gap_cutoff", f"WITH {ALL}, {GAP} SELECT query_id, label, vec_id, score, rank FROM i WHERE near OR (NOT anyone AND rank = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8")
def topk_log_gap_cutoff(spark, d):
    return R.keep_nearby(unscoped(spark, d), "query_id")


@query("retrieve_union_dedupe_best", f"WITH {ALL}, u AS (SELECT label, vec_id, score, query_id FROM t) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id) = 1")
def retrieve_union_dedupe_best(spark, d):
    return R.best_per_id(unscoped(spark, d), ["vec_id"], ["query_id"]).select("label", "vec_id", "score", "query_id")


@query("retrieve_fallback_when_empty", f"WITH {ALL}, p AS (SELECT * FROM t WHERE label = query_id % 7 AND score > 0.3) SELECT * FROM p UNION ALL SELECT * FROM t WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM p)")
def retrieve_fallback_when_empty(spark, d):
    hits = unscoped(spark, d)
    return R.with_fallback(hits.where("label = query_id % 7 and score > 0.3"), hits.where("rank <= 3"), asked(spark, d), "query_id")


@query("retrieve_part_quota", f"WITH {ALL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank, vec_id) = 1 AS first FROM t) SELECT query_id, label, vec_id, score, rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first DESC, rank, vec_id) <= 12")
def retrieve_part_quota(spark, d):
    return R.quota(unscoped(spark, d), "query_id", "label", 12, "vec_id")


@query("selection_budget", f"WITH {ALL} SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY label = query_id % 10 DESC, score DESC, vec_id) <= CASE WHEN query_id % 300 = 0 THEN 3 WHEN query_id % 200 = 0 THEN 6 ELSE 11 END")
def selection_budget(spark, d):
    b = F.when(F.col("query_id") % 300 == 0, 3).when(F.col("query_id") % 200 == 0, 6).otherwise(11)
    return R.within_budget(unscoped(spark, d), "query_id", b, [F.desc(F.col("label") == F.col("query_id") % 10), F.desc("score"), F.col("vec_id")])


@query("retrieval_broaden_missing", f"WITH {ALL}, w AS (SELECT q.query_id, l.label FROM q, (SELECT DISTINCT label FROM embeddings WHERE label < 5) l) SELECT query_id, label FROM w ANTI JOIN (SELECT * FROM t WHERE rank <= 6) USING (query_id, label)")
def retrieval_broaden_missing(spark, d):
    wanted = asked(spark, d).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("label"))
    return R.missing_parts(wanted, unscoped(spark, d).where("rank <= 6"), "query_id", "label")


@query("rerank_by_scores", f"WITH {ALL}, r AS (SELECT query_id, vec_id, (vec_id * 37) % 101 / 101.0 AS s FROM t WHERE vec_id % 3 <> 0) SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS rerank FROM t LEFT JOIN r USING (query_id, vec_id)")
def rerank_by_scores(spark, d):
    hits = unscoped(spark, d)
    scores = hits.where("vec_id % 3 <> 0").select("query_id", "vec_id", (F.col("vec_id") * 37 % 101 / 101.0).alias("score"))
    return R.reranked(hits, scores, "query_id", "vec_id").select("query_id", "label", "vec_id", "score", "rank", "rerank")


@query(
    "visual_page_budget",
    """WITH p AS (SELECT DISTINCT page_id, filing_id, page, page = 1 AS es, coalesce(length(normalized_text), 0) % 7 AS pr FROM page_text), n AS (SELECT *, count(*) OVER (PARTITION BY filing_id) AS n, sum(CAST(es AS INT)) OVER (PARTITION BY filing_id) AS e, row_number() OVER (PARTITION BY filing_id ORDER BY es DESC, pr DESC, page) AS r FROM p)
SELECT page_id FROM n WHERE r <= CASE WHEN n > 8 THEN greatest(e, ceil(n * 0.3)) ELSE n END""",
)
def visual_page_budget(spark, d):
    p = table(spark, d, "page_text").select("page_id", "filing_id", "page", (F.col("page") == 1).alias("es"), (F.coalesce(F.length("normalized_text"), F.lit(0)) % 7).alias("pr")).distinct()
    return R.greedy_pages(p, "filing_id", "page", "es", "pr", above=8).select("page_id")


@query("pending_batches", "WITH c AS (SELECT DISTINCT record_id, file_hash FROM chunks) SELECT record_id, CAST(floor((row_number() OVER (PARTITION BY file_hash ORDER BY record_id) - 1) / 100) AS BIGINT) AS batch FROM c")
def pending_batches(spark, d):
    return R.batched(table(spark, d, "chunks").select("record_id", "file_hash").distinct(), ["file_hash"], ["record_id"], 100).select("record_id", "batch")


@query(
    "char_budget_batches",
    """WITH RECURSIVE c AS (SELECT DISTINCT evidence_id, filing_id, least(coalesce(length(quote), 0), 3000) + 300 AS c FROM finding_evidence), n AS (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY evidence_id) AS n FROM c), b AS (SELECT filing_id, evidence_id, n, c AS used, 0 AS batch FROM n WHERE n = 1
UNION ALL SELECT n.filing_id, n.evidence_id, n.n, CASE WHEN b.used + n.c > 3000 THEN n.c ELSE b.used + n.c END, CASE WHEN b.used + n.c > 3000 THEN b.batch + 1 ELSE b.batch END FROM b JOIN n ON n.filing_id IS NOT DISTINCT FROM b.filing_id AND n.n = b.n + 1) SELECT filing_id, evidence_id, batch FROM b""",
)
def char_budget_batches(spark, d):
    c = table(spark, d, "finding_evidence").select("evidence_id", "filing_id", F.length("quote").alias("n")).distinct()
    return R.char_batches(c, "filing_id", ["evidence_id"], "n", budget=3000)


@query("term_hits", "SELECT DISTINCT evidence_id, CAST(contains(lower(coalesce(quote, '')), 'delay') AS INT) + CAST(contains(lower(coalesce(quote, '')), 'no evidence') AS INT) + CAST(contains(lower(coalesce(quote, '')), 'high court') AS INT) AS term_hits FROM finding_evidence")
def term_hits(spark, d):
    e = table(spark, d, "finding_evidence").select("evidence_id", "quote").distinct()
    return R.lexical_scores(e, "quote", ["delay", "no evidence", "High Court"]).select("evidence_id", "term_hits")


@query("part_filtered_chunks", "SELECT DISTINCT record_id FROM chunks WHERE chunk_kind = 'page' AND document_part_id IN ('index', 'synopsis') AND workspace_id IS NOT NULL")
def part_filtered_chunks(spark, d):
    return table(spark, d, "chunks").where("chunk_kind = 'page' and document_part_id in ('index', 'synopsis') and workspace_id is not null").select("record_id").distinct()


@query("part_excluded_chunks", "SELECT DISTINCT record_id FROM chunks WHERE NOT coalesce(len(document_part_ids) > 0 AND len(list_filter(document_part_ids, lambda x: x NOT IN ('index', 'certificate'))) = 0, false)")
def part_excluded_chunks(spark, d):
    gone = (F.size("document_part_ids") > 0) & (F.size(F.array_except("document_part_ids", F.array(F.lit("index"), F.lit("certificate")))) == 0)
    return table(spark, d, "chunks").where(~F.coalesce(gone, F.lit(False))).select("record_id").distinct()


@query("part_family_match", "SELECT DISTINCT record_id FROM chunks WHERE document_part IS NOT NULL AND (lower(document_part) = 'petition' OR contains(lower(document_part), 'petition') OR list_contains(document_part_ids, 'application'))")
def part_family_match(spark, d):
    low = F.lower("document_part")
    return table(spark, d, "chunks").where(F.col("document_part").isNotNull() & ((low == "petition") | low.contains("petition") | F.coalesce(F.array_contains("document_part_ids", "application"), F.lit(False)))).select("record_id").distinct()


@query("nulls_last_page_order", "WITH c AS (SELECT DISTINCT record_id, file_hash, chunk_kind, primary_page FROM chunks) SELECT record_id, row_number() OVER (PARTITION BY file_hash ORDER BY chunk_kind <> 'summary', primary_page NULLS LAST, record_id) AS place FROM c")
def nulls_last_page_order(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "chunks").select("record_id", "file_hash", "chunk_kind", "primary_page").distinct()
    w = Window.partitionBy("file_hash").orderBy(F.col("chunk_kind") != "summary", F.asc_nulls_last("primary_page"), "record_id")
    return c.select("record_id", F.row_number().over(w).alias("place"))
