"""Queries of page ownership: labels of segments, refined boundaries, numbered families, precedence, audit flags."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import ownership as O
from ..session import table
from .pages import FP, filing_pages

AS = "s AS (SELECT DISTINCT case_id, document_id, coalesce(category, '') AS category, start_page AS s, end_page AS e FROM annotations WHERE start_page >= 1 AND start_page <= end_page)"


def _segments(spark, d):
    a = table(spark, d, "annotations").where("start_page >= 1 and start_page <= end_page")
    return a.select("case_id", "document_id", F.coalesce("category", F.lit("")).alias("category"), F.sequence("start_page", "end_page").alias("pages")).distinct()


@query(
    "segment_page_labels",
    f"""WITH {AS}, p AS (SELECT case_id, document_id, trim(category) AS l, unnest(range(s, e + 1)) AS page FROM s WHERE trim(category) NOT IN ('', 'Unidentified')), f AS (SELECT case_id, page, l, min((document_id, l)) AS o FROM p GROUP BY 1, 2, 3)
SELECT case_id, CAST(page AS INT) AS page, list(l ORDER BY o) AS labels FROM f GROUP BY 1, 2""",
)
def segment_page_labels(spark, d):
    return O.segment_page_labels(_segments(spark, d), "case_id", "document_id", "category", "pages", ["Unidentified"])


#: Marks on every third page, in a series that changes on every fifteenth.
SPANS = f"{FP}, pg AS (SELECT DISTINCT filing_id, page FROM fp), sp AS (SELECT filing_id, label, min(page) AS s, max(page) AS e FROM fp GROUP BY 1, 2), mk AS (SELECT filing_id, page, CASE WHEN page // 3 % 5 = 0 THEN 'R' ELSE 'P' END AS series, page // 3 AS number FROM pg WHERE page % 3 = 0)"


def _spans(spark, d):
    return filing_pages(spark, d).groupBy("filing_id", "label").agg(F.min("page").alias("start"), F.max("page").alias("end"))


@query(
    "refined_by_marks",
    f"""WITH RECURSIVE {SPANS}, w AS (SELECT sp.filing_id, label, s, e, s AS cp, series, number FROM sp JOIN mk ON sp.filing_id = mk.filing_id AND page = s
 UNION ALL SELECT w.filing_id, w.label, w.s, w.e, m.page, w.series, m.number FROM w JOIN mk m ON m.filing_id = w.filing_id AND m.series = w.series AND m.number = w.number + 1 AND m.page > w.cp AND m.page <= w.e),
c AS (SELECT filing_id, label, e, cp FROM w UNION SELECT filing_id, label, e, s FROM sp)
SELECT filing_id, label, row_number() OVER v AS piece, cp AS "start", coalesce(lead(cp) OVER v - 1, e) AS "end" FROM c WINDOW v AS (PARTITION BY filing_id, label ORDER BY cp)""",
)
def refined_by_marks(spark, d):
    n = F.floor(F.col("page") / 3).cast("int")
    marks = filing_pages(spark, d).where("page % 3 = 0").select("filing_id", "page", F.when(n % 5 == 0, "R").otherwise("P").alias("series"), n.alias("number")).distinct()
    return O.refined_by_marks(_spans(spark, d), marks, "filing_id", "label", "start", "end")


@query(
    "refined_by_openings",
    f"""WITH {SPANS}, bl AS (SELECT filing_id, label, unnest(range(s, e + 1)) AS page FROM sp), pc AS (SELECT DISTINCT filing_id, ps, pe, CASE WHEN b % 3 = 0 THEN 'cover' WHEN b % 3 = 1 THEN label ELSE 'other' END AS k, ps % 3 = 0 AS ok FROM (SELECT filing_id, label, page // 2 AS b, min(page) AS ps, max(page) AS pe FROM bl GROUP BY 1, 2, 3) WHERE ps % 7 <> 0),
i AS (SELECT sp.filing_id, sp.label, s, e, ps, pe, k, ok FROM sp JOIN pc ON sp.filing_id = pc.filing_id AND ps >= s AND pe <= e),
r AS (SELECT *, sum(CASE WHEN k = pk AND pp + 1 = ps THEN 0 ELSE 1 END) OVER (PARTITION BY filing_id, label ORDER BY ps, pe, k) AS run FROM (SELECT *, lag(k) OVER v AS pk, lag(pe) OVER v AS pp FROM i WINDOW v AS (PARTITION BY filing_id, label ORDER BY ps, pe, k))),
g AS (SELECT filing_id, label, s, e, run, min(ps) AS ps, max(pe) AS pe, first(k) AS k, arg_min(ok, ps) AS ok, sum(pe - ps + 1) AS n FROM r GROUP BY ALL),
h AS (SELECT *, coalesce(lag(pe) OVER v + 1, s) = ps AND n = pe - ps + 1 AS fol, ps > s AND (ok OR coalesce(lag(k) OVER v = 'cover' AND lag(n) OVER v = 1 AND k <> 'cover', false)) AS cut FROM g WINDOW v AS (PARTITION BY filing_id, label ORDER BY run)),
x AS (SELECT filing_id, label FROM h GROUP BY filing_id, label, e HAVING bool_and(fol) AND max(pe) = e),
c AS (SELECT filing_id, label, s AS cp, e FROM sp UNION SELECT filing_id, label, ps, e FROM h SEMI JOIN x USING (filing_id, label) WHERE cut)
SELECT filing_id, label, row_number() OVER v AS piece, cp AS "start", coalesce(lead(cp) OVER v - 1, e) AS "end" FROM c WINDOW v AS (PARTITION BY filing_id, label ORDER BY cp)""",
)
def refined_by_openings(spark, d):
    spans = _spans(spark, d)
    b = F.floor(F.col("page") / 2).cast("int")
    blocks = spans.select("filing_id", "label", F.explode(F.sequence("start", "end")).alias("page")).groupBy("filing_id", "label", b.alias("b")).agg(F.min("page").alias("start"), F.max("page").alias("end")).where("start % 7 <> 0")
    k = F.when(F.col("b") % 3 == 0, "cover").when(F.col("b") % 3 == 1, F.col("label")).otherwise("other")
    classified = blocks.select("filing_id", "start", "end", k.alias("category"), (F.col("start") % 3 == 0).alias("supported")).distinct()
    return O.refined_by_openings(spans, classified, "filing_id", "label")


@query(
    "numbered_families",
    f"""WITH {FP}, p AS (SELECT DISTINCT filing_id, label, page, CASE WHEN page % 3 = 0 THEN page // 3 END AS n FROM fp), r AS (SELECT *, page - row_number() OVER (PARTITION BY filing_id, label ORDER BY page) AS run FROM p),
m AS (SELECT filing_id, page, label, last_value(n IGNORE NULLS) OVER (PARTITION BY filing_id, label, run ORDER BY page ROWS UNBOUNDED PRECEDING) AS n FROM r), q AS (SELECT DISTINCT filing_id, page, CASE WHEN label IN ('annexures', 'application') AND n IS NOT NULL THEN label || '_' || n ELSE label END AS label FROM m),
i AS (SELECT filing_id, label, min(page) AS s, max(page) AS e, count(*) AS k FROM (SELECT *, page - row_number() OVER (PARTITION BY filing_id, label ORDER BY page) AS run FROM q) GROUP BY filing_id, label, run),
o AS (SELECT *, row_number() OVER (PARTITION BY filing_id, label ORDER BY s) AS a, row_number() OVER (PARTITION BY filing_id, label ORDER BY k DESC, s) AS b FROM i)
SELECT filing_id, label, CAST(unnest(range(s, e + 1)) AS INT) AS page FROM o WHERE CASE WHEN regexp_matches(label, '^(annexures|application)_[0-9]+$') THEN a = 1 ELSE b = 1 END""",
)
def numbered_families(spark, d):
    pages = filing_pages(spark, d).select("filing_id", "page", "label", F.when(F.col("page") % 3 == 0, F.floor(F.col("page") / 3).cast("int")).alias("number"))
    return O.numbered_families(pages, "filing_id", "label", "number", ["annexures", "application"])


@query(
    "owned_pages",
    f"""WITH {FP}, p AS (SELECT filing_id, page, min(label) AS a, max(label) AS b, page % 10 / 10.0 AS c FROM fp GROUP BY 1, 2), m AS (SELECT *, CASE WHEN page % 4 = 0 THEN a END AS x, CASE WHEN c >= 0.7 THEN b END AS y, CASE WHEN page % 5 < 2 THEN a END AS z FROM p)
SELECT filing_id, page, coalesce(x, y, z) AS owner, CASE WHEN x IS NOT NULL THEN 'printed' WHEN y IS NOT NULL THEN 'classified' WHEN z IS NOT NULL THEN 'segment' END AS source, coalesce(x, y, z) IS NULL OR len(list_distinct(list_filter([x, y, z], lambda v: v IS NOT NULL))) > 1 AS needs_review FROM m""",
)
def owned_pages(spark, d):
    p = filing_pages(spark, d).groupBy("filing_id", "page").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return O.owned_pages(p, "filing_id", [("printed", F.col("a"), F.col("page") % 4 == 0), ("classified", F.col("b"), F.col("page") % 10 / 10.0 >= 0.7), ("segment", F.col("a"), F.col("page") % 5 < 2)])


@query(
    "page_review_reasons",
    f"WITH {FP}, p AS (SELECT DISTINCT filing_id, page FROM fp), r AS (SELECT filing_id, page, 'boundary' AS x FROM p WHERE page % 6 = 0 UNION ALL SELECT filing_id, page, 'classification' FROM p WHERE page % 4 = 0 UNION ALL SELECT filing_id, page, 'sharing' FROM fp GROUP BY 1, 2 HAVING count(DISTINCT slot_id) > 1) SELECT filing_id, page, list_sort(list_distinct(list(x))) AS reasons FROM r GROUP BY 1, 2",
)
def page_review_reasons(spark, d):
    p = filing_pages(spark, d)
    shared = p.groupBy("filing_id", "page").agg(F.count_distinct("slot_id").alias("n")).where("n > 1").withColumn("r", F.lit("sharing"))
    return O.review_reasons("filing_id", (p.where("page % 6 = 0").withColumn("r", F.lit("boundary")), "r"), (p.where("page % 4 = 0").withColumn("r", F.lit("classification")), "r"), (shared, "r"))


@query(
    "repeated_segments",
    f"""WITH {FP}, p AS (SELECT DISTINCT filing_id, page FROM fp WHERE label IN ('annexures', 'affidavit', 'application')), o AS (SELECT *, CASE WHEN page // 4 % 3 <> 0 THEN page // 4 END AS seg FROM p),
l AS (SELECT filing_id, 1 AS late, min(page) AS s, max(page) AS e, count(*) AS n FROM (SELECT *, page - row_number() OVER (PARTITION BY filing_id ORDER BY page) AS run FROM o WHERE seg IS NULL) GROUP BY filing_id, run),
x AS (SELECT filing_id, 0 AS late, seg AS ord, min(page) AS s, max(page) AS e, count(*) AS n FROM o WHERE seg IS NOT NULL GROUP BY filing_id, seg UNION ALL SELECT filing_id, late, s, s, e, n FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY late, ord) AS k FROM x), t AS (SELECT DISTINCT filing_id FROM fp WHERE label = 'synopsis')
SELECT filing_id, CAST(CASE WHEN filing_id IN (SELECT filing_id FROM t) THEN CASE WHEN k < 2 THEN k WHEN k < 3 THEN 3 ELSE k + 2 END ELSE k END AS INT) AS number, s AS "start", e AS "end", n AS pages FROM k""",
)
def repeated_segments(spark, d):
    """Numbers 2 and 4 are taken in filings that have a synopsis."""
    p = filing_pages(spark, d)
    own = p.where("label in ('annexures', 'affidavit', 'application')").select("filing_id", "page").distinct()
    seg = F.floor(F.col("page") / 4).cast("int")
    segments = own.select("filing_id", seg.alias("segment")).distinct().where("segment % 3 <> 0").select("filing_id", "segment", F.greatest(F.col("segment") * 4, F.lit(1)).alias("start"), (F.col("segment") * 4 + 3).alias("end"))
    taken = p.where("label = 'synopsis'").select("filing_id").distinct().select("filing_id", F.explode(F.array(F.lit(2), F.lit(4))).alias("number"))
    return O.repeated_segments(own, segments, taken, "filing_id")


@query(
    "split_audit_flags",
    f"""WITH {FP}, c AS (SELECT filing_id, count(DISTINCT page) AS pages, count(DISTINCT page) FILTER (label = 'index') AS ip, count(DISTINCT page) FILTER (label = 'index' AND page % 2 = 0) AS ir, count(DISTINCT page) FILTER (page % 9 <> 0) AS cp, count(DISTINCT page) FILTER (label = 'certificate' AND page % 5 = 0) AS ot FROM fp GROUP BY 1),
s AS (SELECT filing_id, count(*) AS oc FROM (SELECT filing_id, page FROM fp GROUP BY 1, 2 HAVING count(DISTINCT label) > 1) GROUP BY 1), j AS (SELECT * FROM c LEFT JOIN s USING (filing_id))
SELECT filing_id, 'index_missing' AS code, 'warning' AS severity FROM j WHERE ip = 0 UNION ALL SELECT filing_id, 'index_unparsed', 'warning' FROM j WHERE ip > 0 AND ir = 0 UNION ALL SELECT filing_id, 'segment_classification_incomplete', 'warning' FROM j WHERE cp < pages
UNION ALL SELECT filing_id, 'split_ownership_conflict', 'warning' FROM j WHERE oc > 0 UNION ALL SELECT filing_id, 'unresolved_source_transition', 'warning' FROM j WHERE ot > 0""",
)
def split_audit_flags(spark, d):
    p = filing_pages(spark, d)
    when = lambda cond: F.count_distinct(F.when(F.expr(cond), F.col("page")))
    c = p.groupBy("filing_id").agg(F.count_distinct("page").alias("pages"), when("label = 'index'").alias("ip"), when("label = 'index' and page % 2 = 0").alias("ir"), when("page % 9 <> 0").alias("cp"), when("label = 'certificate' and page % 5 = 0").alias("ot"))
    s = p.groupBy("filing_id", "page").agg(F.count_distinct("label").alias("n")).where("n > 1").groupBy("filing_id").agg(F.count("*").alias("oc"))
    return O.audit_flags(c.join(s, "filing_id", "left"), "filing_id", F.col("ip"), F.col("ir"), F.col("pages"), F.col("cp"), F.col("oc"), F.col("ot"))


@query(
    "mention_flags",
    """WITH p AS (SELECT DISTINCT filing_id, normalized_text AS t FROM page_text), m AS (SELECT DISTINCT filing_id, regexp_replace(u, '^([A-Z])\\s*[-–/]?\\s*0*([0-9]+)$', '\\1-\\2') AS label FROM (SELECT filing_id, unnest(regexp_extract_all(upper(coalesce(t, '')), 'ANNEXURES?\\s*[-–:]?\\s*([A-Z]\\s*[-–/]?\\s*[0-9]{1,3})', 1)) AS u FROM p)),
a AS (SELECT DISTINCT filing_id, 'P-' || CAST(regexp_extract(slot_id, '^annexures_0*([0-9]+)$', 1) AS INT) AS label FROM filing_parts WHERE regexp_matches(slot_id, '^annexures_[0-9]+$'))
SELECT filing_id, label, 'annexure_mentioned_not_attached' AS code, 'error' AS severity FROM m ANTI JOIN a USING (filing_id, label) UNION ALL SELECT filing_id, label, 'annexure_attached_not_mentioned', 'warning' FROM a ANTI JOIN m USING (filing_id, label)""",
)
def mention_flags(spark, d):
    from ..functions import text as T

    p = table(spark, d, "page_text").select("filing_id", "normalized_text").distinct()
    mentioned = p.select("filing_id", F.explode(T.annexure_marks("normalized_text")).alias("label"))
    number = F.regexp_extract("slot_id", r"^annexures_(\d+)$", 1)
    attached = table(spark, d, "filing_parts").where(number != "").select("filing_id", F.concat(F.lit("P-"), number.cast("int").cast("string")).alias("label"))
    return O.mention_flags(mentioned, attached, "filing_id", "label")
