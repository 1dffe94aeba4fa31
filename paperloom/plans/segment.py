"""Queries of segmentation: boundary scores, sequence, index checks, ownership, carried labels."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import segment as S
from ..session import table
from .pages import FP, LAB, PT, filing_pages, page_labels, scanned

HEAD = "coalesce(regexp_matches(t, '^\\s*[A-Z][A-Z .()]{5,}'), false)"
NUM = "coalesce(regexp_matches(t, '(?m)^\\W*(1|i)\\W*$'), false)"
BS = f"""{PT}, b AS (SELECT page_id, filing_id, page, CASE WHEN regexp_matches(coalesce(t, ''), 'ANNEXURE') THEN 'annexure' WHEN regexp_matches(coalesce(t, ''), 'Synopsis') THEN 'synopsis' ELSE 'other' END AS label, {HEAD} AS h, coalesce(regexp_matches(t, 'ANNEXURE'), false) AS x, {NUM} AS z, coalesce(length(t), 0) % 10 / 10.0 AS c FROM pt),
s AS (SELECT *, CASE WHEN h THEN 0.35 ELSE 0 END + CASE WHEN x THEN 0.2 ELSE 0 END + CASE WHEN z THEN 0.05 ELSE 0 END + CASE WHEN c >= 0.8 THEN 0.3 ELSE 0 END AS sc, lag(label) OVER w AS pl, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY filing_id ORDER BY page)),
f AS (SELECT filing_id, page, CASE WHEN rn = 1 THEN 1.0 ELSE least(CASE WHEN label = pl THEN least(sc, 0.35) WHEN label = 'other' THEN least(sc, 0.4) ELSE sc END + CASE WHEN page % 5 = 0 THEN 0.15 ELSE 0 END, 1.0) END AS score FROM s)"""


@query("boundary_scores", f"WITH {BS} SELECT filing_id, page, round(score, 3) AS score, CASE WHEN round(score, 3) >= 0.75 THEN 'auto' WHEN round(score, 3) >= 0.55 THEN 'verify' ELSE 'skip' END AS action FROM f")
def boundary_scores(spark, d):
    t = F.coalesce("t", F.lit(""))
    label = F.when(t.rlike("ANNEXURE"), "annexure").when(t.rlike("Synopsis"), "synopsis").otherwise("other")
    p = scanned(spark, d).withColumn("label", label)
    signals = {"heading_change": (t.rlike(r"^\s*[A-Z][A-Z .()]{5,}"), 0.35), "annexure_marker": (t.rlike("ANNEXURE"), 0.20), "page_number_reset": (t.rlike(r"(?m)^\W*(1|i)\W*$"), 0.05)}
    return S.boundary_scores(p, "filing_id", "page", "label", F.length(t) % 10 / 10.0, signals, proposed=F.col("page") % 5 == 0)


RANKS = {x: i for i, x in enumerate(["index", "listing_proforma", "synopsis", "memo_of_parties", "main_petition", "affidavit", "annexures", "application", "vakalatnama", "filing_memo"])}
RANK_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items()) + " END"


@query(
    "sequence_inversions",
    f"""WITH {FP}, sp AS (SELECT filing_id, label, min(page) AS s FROM fp GROUP BY 1, 2), r AS (SELECT *, {RANK_SQL} AS k FROM sp WHERE label <> 'application'),
l AS (SELECT *, lag(label) OVER w AS previous, lag(k) OVER w AS pk FROM r WHERE k IS NOT NULL WINDOW w AS (PARTITION BY filing_id ORDER BY s, label)) SELECT filing_id, label, previous FROM l WHERE k < pk""",
)
def sequence_inversions(spark, d):
    spans = filing_pages(spark, d).groupBy("filing_id", "label").agg(F.min("page").alias("start"))
    return S.sequence_inversions(spans, "filing_id", "label", "start", RANKS, ["application"])


IDX = f"""{FP}, sp AS (SELECT filing_id, label AS part, min(page) AS s, max(page) AS e FROM fp GROUP BY 1, 2), ix AS (SELECT filing_id, part, s + (s % 4) AS s, e + (e % 3) AS e FROM sp WHERE part <> 'certificate' UNION ALL SELECT DISTINCT filing_id, 'schedule', 1, 2 FROM sp),
n AS (SELECT filing_id, max(page) AS n FROM fp GROUP BY 1), j AS (SELECT coalesce(i.filing_id, d.filing_id) AS filing_id, coalesce(i.part, d.part) AS part, i.s AS is_, i.e AS ie, d.s AS ds, d.e AS de FROM ix i FULL JOIN sp d ON i.filing_id = d.filing_id AND i.part = d.part)"""


@query(
    "index_consistency_flags",
    f"""WITH {IDX}, k AS (SELECT j.*, n.n FROM j LEFT JOIN n USING (filing_id))
SELECT filing_id, part, 'index_page_out_of_range' AS code, 'error' AS severity FROM k WHERE ie > n UNION ALL SELECT filing_id, part, 'in_index_missing_in_file', 'error' FROM k WHERE ds IS NULL
UNION ALL SELECT filing_id, part, 'index_page_mismatch', 'warning' FROM k WHERE abs(is_ - ds) > 1 UNION ALL SELECT filing_id, part, 'index_end_page_mismatch', 'error' FROM k WHERE abs(is_ - ds) <= 1 AND abs(ie - de) > 1
UNION ALL SELECT filing_id, part, 'in_file_missing_in_index', 'warning' FROM k WHERE is_ IS NULL""",
)
def index_consistency_flags(spark, d):
    pages = filing_pages(spark, d)
    spans = pages.groupBy("filing_id", F.col("label").alias("part")).agg(F.min("page").alias("start"), F.max("page").alias("end"))
    index = spans.where("part <> 'certificate'").select("filing_id", "part", (F.col("start") + F.col("start") % 4).alias("start"), (F.col("end") + F.col("end") % 3).alias("end"))
    index = index.unionByName(spans.select("filing_id", F.lit("schedule").alias("part"), F.lit(1).alias("start"), F.lit(2).alias("end")).distinct())
    return S.index_flags(index, spans, "filing_id", "part", pages.groupBy("filing_id").agg(F.max("page").alias("n")), "n")


CARRY = f"""{FP}, o AS (SELECT filing_id, page, min(label) AS label FROM fp GROUP BY 1, 2), a AS (SELECT *, page % 3 <> 0 AS accepted FROM o)"""


@query(
    "label_carry",
    f"""WITH {CARRY} SELECT filing_id, page, CASE WHEN accepted AND label IN ('certificate', 'filing_memo') THEN label ELSE coalesce(last_value(CASE WHEN accepted AND label NOT IN ('certificate', 'filing_memo') THEN label END IGNORE NULLS) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING), label) END AS carried FROM a""",
)
def label_carry(spark, d):
    pages = filing_pages(spark, d).groupBy("filing_id", "page").agg(F.min("label").alias("label")).withColumn("accepted", F.col("page") % 3 != 0)
    return S.carried_labels(pages, "filing_id", "page", "label", "accepted", ["certificate", "filing_memo"]).select("filing_id", "page", "carried")


@query(
    "stable_owners",
    f"""WITH {CARRY}, k AS (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY page) AS rn FROM a) SELECT filing_id, page, last_value(CASE WHEN accepted OR rn = 1 THEN label END IGNORE NULLS) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS owner FROM k""",
)
def stable_owners(spark, d):
    pages = filing_pages(spark, d).groupBy("filing_id", "page").agg(F.min("label").alias("label")).withColumn("accepted", F.col("page") % 3 != 0)
    return S.stable_owners(pages, "filing_id", "page", "label", "accepted").select("filing_id", "page", "owner")


@query("label_transitions", f"WITH {LAB}, v AS (SELECT filing_id, page, array_to_string(labels, '+') AS labels FROM pl), w AS (SELECT *, lag(labels) OVER o AS previous, row_number() OVER o AS n FROM v WINDOW o AS (PARTITION BY filing_id ORDER BY page)) SELECT filing_id, page, labels, previous FROM w WHERE n = 1 OR labels IS DISTINCT FROM previous")
def label_transitions(spark, d):
    return S.transitions(page_labels(spark, d), "filing_id", "page", "labels")


@query(
    "ownership_faults",
    """WITH u AS (SELECT case_id, document_id, unnest(range(start_page, end_page + 1)) AS page FROM annotations WHERE start_page >= 1 AND start_page <= end_page), n AS (SELECT case_id, page, count(DISTINCT document_id) AS o FROM u GROUP BY 1, 2),
c AS (SELECT case_id, max(page_count) AS k FROM annotations GROUP BY 1), x AS (SELECT case_id, unnest(range(1, k + 1)) AS page FROM c)
SELECT * FROM (SELECT coalesce(n.case_id, x.case_id) AS case_id, CAST(coalesce(n.page, x.page) AS INT) AS page, CASE WHEN x.page IS NULL THEN 'out_of_range' WHEN n.page IS NULL THEN 'unassigned' WHEN o > 1 THEN 'several_owners' END AS fault FROM n FULL JOIN x ON n.case_id = x.case_id AND n.page = x.page) WHERE fault IS NOT NULL""",
)
def ownership_faults(spark, d):
    a = table(spark, d, "annotations")
    pages = a.where("start_page >= 1 and start_page <= end_page").select("case_id", "document_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return S.ownership_faults(pages, "case_id", "document_id", a.groupBy("case_id").agg(F.max("page_count").alias("n")), "n")


@query(
    "offset_vote",
    f"""WITH {FP}, sp AS (SELECT filing_id, label, min(page) AS s FROM fp GROUP BY 1, 2), e AS (SELECT filing_id, document_part_id AS label, min(page) AS s FROM (SELECT filing_id, replace(lower(document_part), ' ', '_') AS document_part_id, page FROM finding_evidence WHERE document_part IS NOT NULL AND page IS NOT NULL) GROUP BY 1, 2)
SELECT filing_id, e.s - sp.s AS "offset", count(*) AS votes FROM sp JOIN e USING (filing_id, label) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY count(*) DESC, abs(e.s - sp.s), e.s - sp.s) = 1""",
)
def offset_vote(spark, d):
    a = filing_pages(spark, d).groupBy("filing_id", "label").agg(F.min("page").alias("start"))
    e = table(spark, d, "finding_evidence").where("document_part is not null and page is not null")
    b = e.select("filing_id", F.replace(F.lower("document_part"), F.lit(" "), F.lit("_")).alias("label"), "page").groupBy("filing_id", "label").agg(F.min("page").alias("start"))
    return S.coincident_offset(a, b, "filing_id", "label")


@query(
    "absence_proven",
    f"""WITH {FP}, w AS (SELECT filing_id, count(DISTINCT page) AS n, max(page) AS last FROM fp GROUP BY 1)
SELECT filing_id, v.label AS label FROM (SELECT filing_id FROM w WHERE n = last) x, (VALUES ('index'), ('vakalatnama'), ('certificate')) v(label) WHERE (filing_id, v.label) NOT IN (SELECT (filing_id, label) FROM fp)""",
)
def absence_proven(spark, d):
    wanted = spark.createDataFrame([("index",), ("vakalatnama",), ("certificate",)], "label string")
    return S.proven_absent(filing_pages(spark, d), "filing_id", "label", wanted)


@query("incomplete_reads", f"WITH {FP}, e AS (SELECT DISTINCT filing_id, page FROM fp WHERE label = 'main_petition'), g AS (SELECT * FROM e ANTI JOIN (SELECT DISTINCT filing_id, page FROM finding_evidence) USING (filing_id, page)) SELECT filing_id, list(page ORDER BY page) AS missing FROM g GROUP BY 1")
def incomplete_reads(spark, d):
    required = filing_pages(spark, d).where("label = 'main_petition'")
    return S.incomplete_reads(required, table(spark, d, "finding_evidence"), ["filing_id"])


@query("stale_records", "WITH c AS (SELECT DISTINCT record_id, workspace_id, index_generation FROM chunks), n AS (SELECT workspace_id, max(index_generation) AS g FROM c GROUP BY 1) SELECT c.* FROM c LEFT JOIN n USING (workspace_id) WHERE index_generation IS DISTINCT FROM g")
def stale_records(spark, d):
    c = table(spark, d, "chunks").select("record_id", "workspace_id", "index_generation").distinct()
    return S.stale(c, c, ["workspace_id"], "index_generation")
