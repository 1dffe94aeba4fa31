"""Queries over page maps: the pages of filing parts, annotated cases and scanned pages."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import pages as P
from ..session import table

FP = """fp AS (SELECT DISTINCT filing_id, slot_id, regexp_replace(slot_id, '_[0-9]+$', '') AS label, unnest(range(s, e + 1)) AS page
 FROM (SELECT filing_id, slot_id, u."start" AS s, u."end" AS e FROM (SELECT filing_id, slot_id, unnest(page_span) AS u FROM filing_parts WHERE slot_id IS NOT NULL)) WHERE s >= 1 AND s <= e)"""
RUNS = FP + """, g AS (SELECT DISTINCT filing_id, label, page FROM fp), r0 AS (SELECT *, page - row_number() OVER (PARTITION BY filing_id, label ORDER BY page) AS k FROM g),
 runs AS (SELECT filing_id, label, min(page) AS s, max(page) AS e, count(*) AS n FROM r0 GROUP BY filing_id, label, k)"""
PT = "pt AS (SELECT DISTINCT page_id, filing_id, page, normalized_text AS t FROM page_text)"


def filing_pages(spark, d):
    """The distinct (filing, slot, label, page) of all filing parts."""
    parts = table(spark, d, "filing_parts").where("slot_id is not null").select("filing_id", "slot_id", "page_span")
    out = P.expand_spans(parts, "page_span").distinct()
    return out.withColumn("label", F.regexp_replace("slot_id", "_[0-9]+$", ""))


def runs(spark, d):
    return P.islands(filing_pages(spark, d), ["filing_id", "label"])


def scanned(spark, d):
    return table(spark, d, "page_text").select("page_id", "filing_id", "page", F.col("normalized_text").alias("t")).distinct()


@query("page_islands", f"WITH {RUNS} SELECT filing_id, label, s AS \"start\", e AS \"end\", n AS pages FROM runs")
def page_islands(spark, d):
    return runs(spark, d)


@query("page_first_run", f"WITH {RUNS} SELECT filing_id, label, s AS \"start\", e AS \"end\", n AS pages FROM runs QUALIFY row_number() OVER (PARTITION BY filing_id, label ORDER BY s) = 1")
def page_first_run(spark, d):
    return P.first_run(runs(spark, d), ["filing_id", "label"])


@query("page_longest_run", f"WITH {RUNS} SELECT filing_id, label, s AS \"start\", e AS \"end\", n AS pages FROM runs QUALIFY row_number() OVER (PARTITION BY filing_id, label ORDER BY n DESC, s) = 1")
def page_longest_run(spark, d):
    return P.longest_run(runs(spark, d), ["filing_id", "label"])


@query(
    "page_kept_runs",
    f"""WITH {RUNS}, q AS (SELECT *, row_number() OVER (PARTITION BY filing_id, label ORDER BY s) AS a, row_number() OVER (PARTITION BY filing_id, label ORDER BY n DESC, s) AS b FROM runs)
SELECT filing_id, label, s AS "start", e AS "end", n AS pages FROM q WHERE CASE WHEN label IN ('index', 'annexures') THEN true WHEN label LIKE '%petition%' THEN a = 1 ELSE b = 1 END""",
)
def page_kept_runs(spark, d):
    return P.kept_runs(runs(spark, d), "filing_id", "label", ["index", "annexures"], F.col("label").contains("petition"))


@query("page_span_text", f"WITH {RUNS} SELECT filing_id, label, CASE WHEN sum(n) = 1 THEN 'p. ' ELSE 'pp. ' END || string_agg(CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '–' || e END, ', ' ORDER BY s) AS phrase FROM runs GROUP BY 1, 2")
def page_span_text(spark, d):
    return P.span_text(runs(spark, d), ["filing_id", "label"])


@query("page_spans", f"WITH {FP} SELECT filing_id, label, s AS \"start\", e AS \"end\", row_number() OVER (PARTITION BY filing_id ORDER BY s, label) AS ord FROM (SELECT filing_id, label, min(page) AS s, max(page) AS e FROM fp GROUP BY 1, 2)")
def page_spans(spark, d):
    return P.label_spans(filing_pages(spark, d), "filing_id", "label")


@query("page_spans_merged", f"WITH {FP} SELECT filing_id, label, s AS \"start\", e AS \"end\", row_number() OVER (PARTITION BY filing_id ORDER BY s, label) AS ord FROM (SELECT filing_id, CASE WHEN label IN ('synopsis', 'index') THEN 'front_matter' ELSE label END AS label, min(page) AS s, max(page) AS e FROM fp GROUP BY 1, 2)")
def page_spans_merged(spark, d):
    return P.merged_spans(filing_pages(spark, d), "filing_id", "label", {"synopsis": "front_matter", "index": "front_matter"})


@query("coverage_gaps", f"WITH {FP}, b AS (SELECT filing_id, min(page) AS a, max(page) AS z FROM fp GROUP BY 1), x AS (SELECT filing_id, unnest(range(a, z + 1)) AS page FROM b) SELECT filing_id, page FROM x ANTI JOIN fp USING (filing_id, page)")
def coverage_gaps(spark, d):
    return P.coverage_gaps(filing_pages(spark, d), ["filing_id"])


@query(
    "leftover_pages",
    """WITH c AS (SELECT case_id, max(page_count) AS n FROM annotations GROUP BY 1), x AS (SELECT case_id, unnest(range(1, n + 1)) AS page FROM c),
u AS (SELECT DISTINCT case_id, unnest(range(start_page, end_page + 1)) AS page FROM annotations WHERE start_page >= 1 AND start_page <= end_page) SELECT case_id, CAST(page AS INT) AS page FROM x ANTI JOIN u USING (case_id, page)""",
)
def leftover_pages(spark, d):
    a = table(spark, d, "annotations")
    used = a.where("start_page >= 1 and start_page <= end_page").select("case_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return P.leftover_pages(a.groupBy("case_id").agg(F.max("page_count").alias("n")), used, "case_id", "n")


@query("page_slot_map", f"WITH {FP} SELECT filing_id, bucket, list(DISTINCT page ORDER BY page) AS pages FROM fp JOIN (SELECT DISTINCT document_part_id AS label, left(document_part_id, 1) AS bucket FROM chunks WHERE document_part_id IS NOT NULL) USING (label) GROUP BY 1, 2")
def page_slot_map(spark, d):
    slots = table(spark, d, "chunks").where("document_part_id is not null").select(F.col("document_part_id").alias("label"), F.left("document_part_id", F.lit(1)).alias("bucket"))
    return P.slot_pages(filing_pages(spark, d), slots, "filing_id", "label", "bucket")


SPANS = """sp AS (SELECT filing_id, slot_id, u."start" AS s, u."end" AS e FROM (SELECT filing_id, slot_id, unnest(page_span) AS u FROM filing_parts WHERE slot_id IS NOT NULL) WHERE u."start" >= 1 AND u."start" <= u."end"),
w0 AS (SELECT filing_id, slot_id, s, unnest(range(s, e + 1)) AS page FROM sp), w AS (SELECT filing_id, slot_id, page, min(s) AS s FROM w0 GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY filing_id, slot_id ORDER BY s, page) AS local_page, count(*) OVER (PARTITION BY filing_id, slot_id) AS want FROM w),
j AS (SELECT n.*, count(*) OVER (PARTITION BY filing_id, slot_id) AS got FROM n JOIN (SELECT DISTINCT filing_id, page FROM page_text) USING (filing_id, page))"""


def _spans(spark, d):
    parts = table(spark, d, "filing_parts").where("slot_id is not null")
    return parts.select("filing_id", "slot_id", F.explode("page_span").alias("u")).select("filing_id", "slot_id", "u.start", "u.end")


@query("span_renumber", f"WITH {SPANS} SELECT filing_id, slot_id, local_page, page FROM j WHERE got = want")
def span_renumber(spark, d):
    return P.renumbered(table(spark, d, "page_text"), _spans(spark, d), "filing_id", "slot_id")


@query("span_renumber_partial", f"WITH {SPANS} SELECT filing_id, slot_id, local_page, page FROM j")
def span_renumber_partial(spark, d):
    return P.renumbered(table(spark, d, "page_text"), _spans(spark, d), "filing_id", "slot_id", complete=False)


@query("stitch_pages", f"WITH {FP} SELECT filing_id, slot_id, page, row_number() OVER (PARTITION BY filing_id ORDER BY slot_id, page) AS global_page FROM fp")
def stitch_pages(spark, d):
    return P.stitched(filing_pages(spark, d), "filing_id", ["slot_id"]).select("filing_id", "slot_id", "page", "global_page")


CP = "cp AS (SELECT file_hash, primary_page AS page, any_value(document_part_ids) AS parts, string_agg(chunk_text, chr(10) ORDER BY chunk_index, record_id) AS t FROM (SELECT DISTINCT record_id, file_hash, primary_page, chunk_index, document_part_ids, chunk_text FROM chunks WHERE primary_page IS NOT NULL AND chunk_index IS NOT NULL AND chunk_text IS NOT NULL) GROUP BY 1, 2)"


@query(
    "neighbour_overlap",
    f"""WITH {PT}, w AS (SELECT page_id, page, t, filing_id, [page_id // 20] AS parts, lag(page) OVER o AS pp, lag(t) OVER o AS pt, lag([page_id // 20]) OVER o AS ppart, lead(page) OVER o AS np, lead(t) OVER o AS nt, lead([page_id // 20]) OVER o AS npart FROM pt WINDOW o AS (PARTITION BY filing_id ORDER BY page))
SELECT page_id, CASE WHEN pp = page - 1 AND list_has_any(parts, ppart) THEN right(pt, 200) END AS before, CASE WHEN np = page + 1 AND list_has_any(parts, npart) THEN left(nt, 200) END AS "after" FROM w""",
)
def neighbour_overlap(spark, d):
    pages = scanned(spark, d).withColumn("parts", F.array(F.floor(F.col("page_id") / 20)))
    return P.neighbour_overlap(pages, "filing_id", "page", "parts", "t").select("page_id", "before", "after")


@query(
    "adjacent_context",
    """WITH c AS (SELECT DISTINCT record_id, file_hash, document_part_id AS p, primary_page, chunk_index FROM chunks WHERE chunk_kind = 'page' AND document_part_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY file_hash, p ORDER BY primary_page NULLS FIRST, chunk_index NULLS FIRST, record_id) AS i FROM c)
SELECT a.record_id, b.record_id AS neighbour, CAST(b.i - a.i AS INT) AS step FROM n a JOIN n b ON a.file_hash = b.file_hash AND a.p = b.p AND b.i IN (a.i - 2, a.i - 1, a.i + 1, a.i + 2)""",
)
def adjacent_context(spark, d):
    c = table(spark, d, "chunks").where("chunk_kind = 'page' and document_part_id is not null").select("record_id", "file_hash", "document_part_id", "primary_page", "chunk_index").distinct()
    return P.adjacent(c, ["file_hash", "document_part_id"], ["primary_page", "chunk_index", "record_id"], "record_id")


@query(
    "nearest_same_part",
    """WITH c AS (SELECT DISTINCT record_id, file_hash, document_part_id AS p, primary_page AS g, length(trim(chunk_text)) AS n FROM chunks WHERE chunk_kind = 'page' AND document_part_id IS NOT NULL AND primary_page IS NOT NULL AND chunk_text IS NOT NULL),
x AS (SELECT a.file_hash, a.p AS document_part_id, a.record_id, b.record_id AS nearest, abs(b.g - a.g) AS distance FROM c a JOIN c b ON a.file_hash = b.file_hash AND a.p = b.p AND a.n < 200 AND b.n >= 200
 QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY abs(b.g - a.g), b.g, b.record_id) = 1) SELECT * FROM x""",
)
def nearest_same_part(spark, d):
    c = table(spark, d, "chunks").where("chunk_kind = 'page' and document_part_id is not null and primary_page is not null and chunk_text is not null")
    c = c.select("record_id", "file_hash", "document_part_id", "primary_page", F.length(F.trim("chunk_text")).alias("n")).distinct()
    return P.nearest_same_part(c.where("n < 200"), c.where("n >= 200"), ["file_hash", "document_part_id"], "record_id", "primary_page")


@query("continuation_pages", f"WITH {FP} SELECT a.filing_id, a.label, a.page, b.page AS previous_page FROM (SELECT DISTINCT filing_id, label, page FROM fp) a JOIN (SELECT DISTINCT filing_id, label, page FROM fp) b ON a.filing_id = b.filing_id AND a.label = b.label AND b.page = a.page - 1")
def continuation_pages(spark, d):
    return P.continuation_pages(filing_pages(spark, d).select("filing_id", "label", "page").distinct(), "filing_id", "label")


LAB = FP + ", pl AS (SELECT filing_id, page, list(DISTINCT label ORDER BY label) AS labels FROM fp GROUP BY 1, 2)"


def page_labels(spark, d):
    return filing_pages(spark, d).groupBy("filing_id", "page").agg(F.array_join(F.sort_array(F.collect_set("label")), "+").alias("labels"))


SEG = LAB + """, s0 AS (SELECT filing_id, page, array_to_string(labels, '+') AS v FROM pl), s1 AS (SELECT *, CASE WHEN lag(page) OVER w = page - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS c FROM s0 WINDOW w AS (PARTITION BY filing_id ORDER BY page)),
s2 AS (SELECT *, sum(c) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS n FROM s1), seg AS (SELECT filing_id, n, min(page) AS s, max(page) AS e, any_value(v) AS v FROM s2 GROUP BY 1, 2)"""


@query("label_segments", f"WITH {SEG} SELECT filing_id, format('segment_{{:04d}}', CAST(n AS INT)) AS segment_id, s AS \"start\", e AS \"end\", v AS value FROM seg")
def label_segments(spark, d):
    return P.run_segments(page_labels(spark, d), "filing_id", "page", F.col("labels"))


@query("cut_set", f"WITH {LAB} SELECT a.filing_id, a.page FROM pl a JOIN pl b ON a.filing_id = b.filing_id AND b.page = a.page + 1 WHERE len(a.labels) = 1 AND len(b.labels) = 1 AND a.labels <> b.labels")
def cut_set(spark, d):
    from ..operators.segment import cut_set

    return cut_set(filing_pages(spark, d), "filing_id", "label")


@query("dominant_label", f"WITH {FP} SELECT filing_id, label, count(*) AS n FROM fp GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY count(*) DESC, label DESC) = 1")
def dominant_label(spark, d):
    return P.dominant_label(filing_pages(spark, d), "filing_id", "label")


@query("gap_even_split", f"WITH {PT} SELECT page_id, ntile(3) OVER (PARTITION BY filing_id ORDER BY page) AS mark FROM pt")
def gap_even_split(spark, d):
    return P.even_gap_split(scanned(spark, d), ["filing_id"], "page", 3).select("page_id", "mark")


OPEN = "coalesce(regexp_matches(t, '(?m)^\\s*(ANNEXURE|IN THE MATTER)'), false)"


@query("family_counters", f"WITH {PT}, o AS (SELECT page_id, filing_id, page, CAST({OPEN} AS INT) AS x FROM pt) SELECT page_id, CAST(CASE WHEN sum(x) OVER (PARTITION BY filing_id) >= 2 THEN sum(x) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS family_no FROM o")
def family_counters(spark, d):
    opens = F.coalesce(F.col("t").rlike(r"(?m)^\s*(ANNEXURE|IN THE MATTER)"), F.lit(False))
    return P.family_counters(scanned(spark, d), "filing_id", "page", opens).select("page_id", "family_no")


@query("slot_renumber", f"WITH {FP}, f AS (SELECT filing_id, label, slot_id, min(page) AS s FROM fp GROUP BY 1, 2, 3) SELECT filing_id, slot_id, dense_rank() OVER (PARTITION BY filing_id, label ORDER BY s) AS number FROM f")
def slot_renumber(spark, d):
    first = filing_pages(spark, d).groupBy("filing_id", "label", "slot_id").agg(F.min("page").alias("start"))
    return P.source_order_numbers(first, "filing_id", "label", "start").select("filing_id", "slot_id", "number")


@query("extract_page_windows", f"WITH {PT}, r AS (SELECT page_id, row_number() OVER (PARTITION BY filing_id ORDER BY page) AS a, row_number() OVER (PARTITION BY filing_id ORDER BY page DESC) AS b FROM pt) SELECT page_id FROM r WHERE a <= 8 OR b <= 3")
def extract_page_windows(spark, d):
    return P.page_windows(scanned(spark, d), "filing_id", "page", 8, 3).select("page_id")
