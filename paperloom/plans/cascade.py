"""Composed queries: the evidence cascade, extract packs, signed callbacks, nested numbers."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import documents as D
from ..operators import relations as L
from ..operators import retrieval as R
from ..session import materialise, table
from .pages import FP, filing_pages, scanned
from .relations import FE, evidence
from .retrieval import ALL, IN, asked, scoped, unscoped

KEY = b"shared secret"


def evidence_cascade(primary, broad, wanted, budget=12):
    """The evidence of each query.

    The hits of its own scope first; for wanted parts that these lack the hits of a broader
    search; of one id the best; cut where the score falls off; at least the best of each part,
    then by rank, within the budget.
    """
    primary, broad = materialise(primary), materialise(broad)
    gone = R.missing_parts(wanted, primary, "query_id", "label")
    more = broad.join(gone, ["query_id", "label"], "left_semi")
    every = R.best_per_id(primary.withColumn("source", F.lit(0)).unionByName(more.withColumn("source", F.lit(1))), ["query_id", "vec_id"], ["source"])
    from pyspark.sql import Window

    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return R.quota(R.keep_nearby(ranked, "query_id", gap=1.5, most=30), "query_id", "label", budget, "vec_id").select("query_id", "label", "vec_id", "score", "source")


SECOND = ALL[ALL.index("s AS") :].replace("s AS (", "s2 AS (", 1).replace("FROM s QUALIFY", "FROM s2 QUALIFY").replace("t AS (", "t2 AS (", 1)


@query(
    "evidence_cascade",
    f"""WITH {IN}, {SECOND}, w AS (SELECT query_id, unnest([0, 1, 2]) AS label FROM q), g AS (SELECT * FROM w ANTI JOIN t USING (query_id, label)),
u AS (SELECT query_id, label, vec_id, score, 0 AS source FROM t UNION ALL SELECT query_id, label, vec_id, score, 1 FROM t2 SEMI JOIN g USING (query_id, label)),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY score DESC, source) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM b),
n AS (SELECT *, coalesce(best <= 0 OR (score > 0 AND ln(best / CASE WHEN score > 0 THEN score END) <= 1.5), false) AS near FROM r), a AS (SELECT *, max(near) OVER (PARTITION BY query_id) AS anyone FROM n),
k AS (SELECT * FROM a WHERE near OR (NOT anyone AND rank = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 30), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank, vec_id) = 1 AS first FROM k)
SELECT query_id, label, vec_id, score, source FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first DESC, rank, vec_id) <= 12""",
)
def evidence_cascade_query(spark, d):
    wanted = asked(spark, d).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("label"))
    return evidence_cascade(scoped(spark, d), unscoped(spark, d), wanted)


@query("enabled_checks", f"WITH {FE} SELECT check_id FROM fe WHERE status = 'fail' AND check_id IS NOT NULL INTERSECT SELECT check_id FROM fe WHERE status = 'pass'")
def enabled_checks(spark, d):
    fe = evidence(spark, d).where("check_id is not null")
    return fe.where("status = 'fail'").select("check_id").intersect(fe.where("status = 'pass'").select("check_id"))


SOURCES = [("high court", ["hc"]), ("tribunal", ["appellate forum"]), ("registrar", ["tehsildar", "collector"])]


@query("source_citations", f"WITH {FE}, l AS (SELECT evidence_id, lower(coalesce(quote, '')) AS q FROM fe) SELECT evidence_id, list_filter([CASE WHEN contains(q, 'high court') OR contains(q, 'hc') THEN 'high court' END, CASE WHEN contains(q, 'tribunal') OR contains(q, 'appellate forum') THEN 'tribunal' END, CASE WHEN contains(q, 'registrar') OR contains(q, 'tehsildar') OR contains(q, 'collector') THEN 'registrar' END], lambda x: x IS NOT NULL) AS sources FROM l")
def source_citations(spark, d):
    return evidence(spark, d).select("evidence_id", T.cited("quote", SOURCES).alias("sources"))


@query("nested_confidence", "SELECT event_id, round((value + CAST(json_extract(props, '$.k') AS DOUBLE)) / 2, 4) AS confidence FROM events")
def nested_confidence(spark, d):
    payload = F.concat(F.lit('{"a": {"c": '), F.col("value").cast("string"), F.lit('}, "b": '), F.col("props"), F.lit(', "t": "x"}'))
    leaves = D.flattened_json(table(spark, d, "events").select("event_id", payload.alias("p")), ["event_id"], "p")
    return leaves.groupBy("event_id").agg(F.round(F.avg(F.col("value").try_cast("double")), 4).alias("confidence"))


@query(
    "extract_packs",
    f"""WITH {FP}, p AS (SELECT DISTINCT page_id, filing_id, page, normalized_text AS t FROM page_text), w AS (SELECT DISTINCT filing_id, page FROM fp WHERE label IN ('index', 'synopsis', 'main_petition', 'memo_of_parties'))
SELECT filing_id, count(*) AS pages, md5(string_agg('## Page ' || page || chr(10) || coalesce(t, ''), chr(10) || chr(10) ORDER BY page)) AS h FROM p SEMI JOIN w USING (filing_id, page) GROUP BY 1""",
)
def extract_packs(spark, d):
    wanted = filing_pages(spark, d).where("label in ('index', 'synopsis', 'main_petition', 'memo_of_parties')").select("filing_id", "page").distinct()
    pages = scanned(spark, d).join(wanted, ["filing_id", "page"], "left_semi")
    part = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n"), F.coalesce("t", F.lit("")))
    rows = pages.groupBy("filing_id").agg(F.sort_array(F.collect_list(F.struct("page", part.alias("x")))).alias("r"))
    return rows.select("filing_id", F.size("r").cast("bigint").alias("pages"), F.md5(F.array_join(F.transform("r", lambda v: v["x"]), "\n\n").cast("binary")).alias("h"))


PADS = [bytes(b ^ n for b in KEY.ljust(64, b"\0")).hex() for n in (0x5C, 0x36)]


@query("signed_callbacks", f"SELECT event_id, sha256(unhex('{PADS[0]}') || unhex(sha256(unhex('{PADS[1]}') || encode('job ' || event_id || ' ' || event_type)))) AS signature FROM events")
def signed_callbacks(spark, d):
    message = F.concat(F.lit("job "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    return table(spark, d, "events").select("event_id", T.hmac_sha256(message, KEY).alias("signature"))


@query("batch_results", f"WITH {FE} SELECT evidence_id, CASE WHEN evidence_id % 3 = 0 THEN NULL ELSE coalesce(status, 'none') END AS result, CASE WHEN evidence_id % 3 = 0 THEN 'no answer' END AS error FROM fe")
def batch_results(spark, d):
    asked_ = evidence(spark, d)
    answers = asked_.where("evidence_id % 3 <> 0").select("evidence_id", F.coalesce("status", F.lit("none")).alias("result"))
    out = L.with_lookup(asked_.select("evidence_id"), answers, "evidence_id", "result")
    return out.withColumn("error", F.when(F.col("result").isNull(), "no answer"))
