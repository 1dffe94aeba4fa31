"""Queries over records: paths, slices, codes, slots, layouts, rows of tables, generations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import quality as Q
from ..operators import records as R
from ..operators import retrieval as V
from ..session import table
from .pages import FP, PT, filing_pages, scanned
from .quality import TRUTH, _guess, _truth
from .relations import FE
from .retrieval import ALL, asked, unscoped


@query("path_values", "SELECT event_id, json_extract_string(j, '$.a.k') AS found, json_extract_string(j, '$.a.none') AS lost FROM (SELECT event_id, CAST('{\"a\":' || props || '}' AS JSON) AS j FROM events)")
def path_values(spark, d):
    j = F.concat(F.lit('{"a":'), F.col("props"), F.lit("}"))
    return table(spark, d, "events").select("event_id", R.value_at(j, "a.k").alias("found"), R.value_at(j, "a.none.k").alias("lost"))


@query("sliced_records", "SELECT DISTINCT filing_id, CASE WHEN workspace_id LIKE '%1' THEN court END AS court, petition_type, CAST((court IS NOT NULL AND workspace_id LIKE '%1') AS INT) + CAST(petition_type IS NOT NULL AS INT) AS n FROM filings WHERE workspace_id IS NOT NULL")
def sliced_records(spark, d):
    """Workspaces that end in 1 see the court and the type, others the type."""
    allowed = F.when(F.col("workspace_id").endswith("1"), F.array(F.lit("court"), F.lit("petition_type"))).otherwise(F.array(F.lit("petition_type")))
    m = R.sliced_record(F.to_json(F.struct("court", "petition_type", "organization_id")), allowed)
    return table(spark, d, "filings").where("workspace_id is not null").select("filing_id", m.alias("m")).select("filing_id", F.try_element_at("m", F.lit("court")).alias("court"), F.try_element_at("m", F.lit("petition_type")).alias("petition_type"), F.size("m").alias("n")).distinct()


@query("finding_codes", f"WITH {FE} SELECT DISTINCT evidence_id, coalesce(nullif(trim(check_id), ''), nullif(trim(slot_id), ''), nullif(trim(document_part), '')) AS code, regexp_replace(lower(coalesce(nullif(trim(status), ''), 'not run')), '[\\s-]+', '_', 'g') AS status FROM finding_evidence")
def finding_codes(spark, d):
    e = table(spark, d, "finding_evidence")
    return e.select("evidence_id", R.first_code(F.col("check_id"), F.col("slot_id"), F.col("document_part")).alias("code"), R.plain_status(F.col("status"), F.lit("not run")).alias("status")).distinct()


@query(
    "label_order",
    """WITH l AS (SELECT DISTINCT filing_id, coalesce(nullif(regexp_replace(replace(slot_id, 'annexures_', 'Annexure P-'), '^application_', 'annexure R'), ''), '') AS label FROM filing_parts WHERE slot_id IS NOT NULL)
SELECT filing_id, label, row_number() OVER (PARTITION BY filing_id ORDER BY CASE WHEN regexp_matches(label, '(?i)^annexure\\s+[a-z]-?[0-9]+$') THEN CASE upper(regexp_extract(label, '(?i)^annexure\\s+([a-z])', 1)) WHEN 'P' THEN 0 WHEN 'R' THEN 1 ELSE 2 END ELSE 99 END, CASE WHEN regexp_matches(label, '(?i)^annexure\\s+[a-z]-?[0-9]+$') THEN CAST(regexp_extract(label, '([0-9]+)$', 1) AS INT) ELSE 9999 END, label) AS place FROM l""",
)
def label_order(spark, d):
    label = F.regexp_replace(F.replace("slot_id", F.lit("annexures_"), F.lit("Annexure P-")), "^application_", "annexure R")
    rows = table(spark, d, "filing_parts").where("slot_id is not null").select("filing_id", label.alias("label")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("filing_id").orderBy(*R.label_order("label"), "label")))


@query("usage_lines", "WITH u AS (SELECT l_returnflag AS k, l_linestatus AS s, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL ELSE CAST(sum(l_quantity) AS BIGINT) END AS n, count(*) AS p FROM lineitem GROUP BY 1, 2) SELECT k, s, CASE WHEN n IS NULL THEN 'usage pending (' || p || ' job(s) not billed yet)' ELSE n || ' credits (~$' || printf('%.4f', n * 0.5) || ') [' || k || ']' END AS line FROM u")
def usage_lines(spark, d):
    u = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("s")).agg(F.sum("l_quantity").cast("bigint").alias("n"), F.count("*").alias("p"))
    n = F.when(~((F.col("s") == "O") & (F.col("k") == "N")), F.col("n"))
    return u.select("k", "s", R.usage_line(n, F.col("p"), n * 0.5, F.col("k")).alias("line"))


SLOTS = {"index": "index", "annexures": "annexure", "application": "application", "main_petition": "petition"}


@query(
    "file_slots",
    """WITH f AS (SELECT DISTINCT document_id, slot_id, lower(regexp_replace(trim(regexp_replace(coalesce(filename, ''), '(?i)\\.pdf$', '')), '[\\s-]+', '_', 'g')) AS b FROM filing_parts WHERE document_id IS NOT NULL), g AS (SELECT *, regexp_extract(b, '^(.*?)_?[0-9]*$', 1) AS n, regexp_extract(b, '_?([0-9]+)$', 1) AS k FROM f),
h AS (SELECT *, CASE n WHEN 'index' THEN 'index' WHEN 'annexures' THEN 'annexure' WHEN 'application' THEN 'application' WHEN 'main_petition' THEN 'petition' END AS fam FROM g)
SELECT DISTINCT document_id, coalesce(CASE WHEN slot_id LIKE 'v%' THEN slot_id END, CASE WHEN fam IS NOT NULL AND k <> '' THEN fam || '_' || regexp_replace(k, '^0+([0-9])', '\\1') END, fam, 'others') AS slot, coalesce(CASE WHEN n IN ('index', 'application') THEN n END, CASE WHEN b LIKE '%petition%' THEN 'petition' END) AS kind FROM h""",
)
def file_slots(spark, d):
    stem = F.regexp_replace(F.coalesce("filename", F.lit("")), r"(?i)\.pdf$", "")
    slot = R.slot_of(F.when(F.col("slot_id").startswith("v"), F.col("slot_id")), stem, SLOTS, "others")
    base = F.lower(F.regexp_replace(F.trim(stem), r"[\s-]+", "_"))
    kind = R.resolved(["index", "application", "petition"], F.regexp_extract(base, r"^(.*?)_?\d*$", 1), F.when(base.contains("petition"), F.lit("petition")))
    return table(spark, d, "filing_parts").where("document_id is not null").select("document_id", slot.alias("slot"), kind.alias("kind")).distinct()


@query("eligible_pages", "SELECT filing_id, count(DISTINCT page) FILTER (ocr_status = 'ocr' AND length(trim(normalized_text)) > 0) AS pages FROM page_text GROUP BY 1")
def eligible_pages(spark, d):
    return R.eligible_pages(table(spark, d, "page_text"), "filing_id", "page", (F.col("ocr_status") == "ocr") & (F.length(F.trim("normalized_text")) > 0))


@query("index_of_check", f"WITH {FP}, s AS (SELECT DISTINCT filing_id, page FROM fp WHERE label IN ('affidavit', 'vakalatnama')) SELECT DISTINCT e.evidence_id FROM finding_evidence e SEMI JOIN s ON e.filing_id = s.filing_id AND e.page = s.page")
def index_of_check(spark, d):
    own = filing_pages(spark, d).where("label in ('affidavit', 'vakalatnama')")
    return R.of_check(table(spark, d, "finding_evidence"), own, ["filing_id", "page"]).select("evidence_id").distinct()


@query("tenant_scope", "SELECT DISTINCT filing_id FROM filings WHERE organization_id = 'org_001' AND workspace_id = 'ws_001_3'")
def tenant_scope(spark, d):
    return R.in_scope(table(spark, d, "filings"), {"organization_id": "org_001", "workspace_id": "ws_001_3"}).select("filing_id").distinct()


WORDS = f"{PT}, w AS (SELECT page_id, filing_id, page, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS n FROM (SELECT *, string_split_regex(trim(t), '\\s+') AS ws FROM pt WHERE length(trim(t)) > 0))"


def _words(spark, d):
    t = scanned(spark, d).where("length(trim(t)) > 0")
    return t.select("page_id", "filing_id", "page", F.posexplode(F.split(F.trim("t"), r"\s+")).alias("at", "word"))


@query(
    "stitched_words",
    f"""WITH {WORDS}, n AS (SELECT filing_id, (page - 1) // 3 AS part, max(page) - (page - 1) // 3 * 3 AS n FROM pt GROUP BY filing_id, (page - 1) // 3), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY filing_id ORDER BY -part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n WHERE part <> 1)
SELECT w.page_id, CAST(w.page - o.part * 3 + o.b AS BIGINT) AS stitched_page, count(*) AS words FROM w JOIN o ON w.filing_id = o.filing_id AND (w.page - 1) // 3 = o.part GROUP BY 1, 2""",
)
def stitched_words(spark, d):
    """Parts of three pages each, put together from the last to the first, without the second."""
    part = F.floor((F.col("page") - 1) / 3).cast("int")
    words = _words(spark, d).withColumn("part", part).withColumn("local", F.col("page") - F.col("part") * 3)
    parts = scanned(spark, d).groupBy("filing_id", part.alias("part")).agg((F.max("page") - F.max(part) * 3).alias("n")).where("part <> 1").withColumn("order", -F.col("part"))
    return R.stitched_words(words, parts, ["filing_id"], "part", "local", "order", "n").groupBy("page_id", F.col("stitched_page").cast("bigint").alias("stitched_page")).agg(F.count("*").alias("words"))


@query("merged_words", f"WITH {WORDS}, a AS (SELECT page_id, upper(word) AS word, n FROM w WHERE page % 2 = 0 AND n % 2 = 0), m AS (SELECT * FROM a UNION ALL SELECT page_id, word, n FROM w WHERE page_id NOT IN (SELECT page_id FROM a)) SELECT page_id, count(*) AS words, count(*) FILTER (word = upper(word)) AS upper_words FROM m GROUP BY 1")
def merged_words(spark, d):
    w = _words(spark, d)
    text_layer = w.where("page % 2 = 0 and at % 2 = 0").select("page_id", F.upper("word").alias("word"), "at")
    m = R.merged_words(text_layer, w.select("page_id", "word", "at"), ["page_id"])
    return m.groupBy("page_id").agg(F.count("*").alias("words"), F.count_if(F.col("word") == F.upper("word")).alias("upper_words"))


@query("quote_rows", f"WITH {PT}, r AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: list_filter(list_transform(string_split_regex(x, '\\s*[|\\t]\\s*'), lambda c: regexp_replace(trim(c), '^(?:No\\.|Page)\\s*:\\s*', '')), lambda c: c <> '')), lambda y: len(y) > 1 AND len(list_filter(y, lambda c: NOT regexp_full_match(c, '[-=\\s:]+'))) > 0) AS rs FROM pt WHERE t IS NOT NULL) SELECT page_id, len(rs) AS n_rows, len(flatten(rs)) AS cells, md5(array_to_string(flatten(rs), '|')) AS h FROM r WHERE len(rs) > 0")
def quote_rows(spark, d):
    r = scanned(spark, d).where("t is not null").select("page_id", R.quote_rows("t", ["No.", "Page"]).alias("rs")).where(F.size("rs") > 0)
    return r.select("page_id", F.size("rs").alias("n_rows"), F.size(F.flatten("rs")).alias("cells"), F.md5(F.array_join(F.flatten("rs"), "|").cast("binary")).alias("h"))


@query("image_plans", f"WITH {FE}, c AS (SELECT check_id, page, max(CASE WHEN slot_id = 'index' THEN 120 ELSE CAST(floor(confidence * 100) AS INT) END) AS priority FROM finding_evidence WHERE page IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY priority DESC, page) AS place FROM c) SELECT check_id, page, priority, place, place <= 4 AS kept FROM n")
def image_plans(spark, d):
    e = table(spark, d, "finding_evidence").where("page is not null and confidence is not null")
    return R.best_images(e.withColumn("priority", F.when(F.col("slot_id") == "index", 120).otherwise(F.floor(F.col("confidence") * 100).cast("int"))), "check_id", "page", "priority")


@query("generation_after_run", "WITH p AS (SELECT n_nationkey AS k, 'g1' AS generation FROM nation WHERE n_nationkey % 5 <> 0), r AS (SELECT n_nationkey AS k, 'g2' AS generation, n_nationkey % 3 = 0 AS ok FROM nation WHERE n_nationkey % 7 <> 0) SELECT coalesce(p.k, r.k) AS k, CASE WHEN coalesce(ok, false) THEN r.generation ELSE p.generation END AS generation, CASE WHEN coalesce(ok, false) THEN p.generation ELSE r.generation END AS dropped, coalesce(ok, false) AND p.generation IS NOT NULL AS stale FROM p FULL JOIN r ON p.k = r.k")
def generation_after_run(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return R.switched(n.where("k % 5 <> 0").withColumn("generation", F.lit("g1")), n.where("k % 7 <> 0").select("k", F.lit("g2").alias("generation"), (F.col("k") % 3 == 0).alias("succeeded")), "k")


# ------------------------------------------------------------ validation of sets, metrics


CS = "c AS (SELECT DISTINCT record_id, workspace_id, index_generation, chunk_kind, file_hash, primary_page, chunk_index, content_hash FROM chunks)"


@query(
    "validator_set_issues",
    f"""WITH {CS}, p AS (SELECT * FROM c WHERE chunk_kind IN ('page', 'page_manifest')), s AS (SELECT workspace_id, index_generation, count(*) FILTER (chunk_kind = 'summary') AS n FROM c GROUP BY 1, 2), g AS (SELECT *, lead(primary_page) OVER (PARTITION BY workspace_id, index_generation ORDER BY primary_page) AS nx FROM (SELECT DISTINCT workspace_id, index_generation, primary_page FROM p WHERE primary_page IS NOT NULL))
SELECT workspace_id, index_generation, 'missing_summary' AS code, 'warning' AS severity, NULL AS subject FROM s WHERE n = 0 UNION ALL SELECT workspace_id, index_generation, 'duplicate_summary', 'error', CAST(n AS VARCHAR) FROM s WHERE n > 1
UNION ALL SELECT workspace_id, index_generation, 'duplicate_logical_chunk', 'error', coalesce(file_hash, '?') || '/' || coalesce(chunk_kind, '?') || '/' || coalesce(CAST(primary_page AS VARCHAR), '?') || '/' || coalesce(CAST(chunk_index AS VARCHAR), '?') FROM p GROUP BY workspace_id, index_generation, file_hash, chunk_kind, primary_page, chunk_index HAVING count(*) > 1
UNION ALL SELECT workspace_id, index_generation, 'duplicate_content', 'warning', content_hash FROM c WHERE chunk_kind = 'page' AND trim(content_hash) <> '' GROUP BY workspace_id, index_generation, content_hash HAVING count(*) > 1
UNION ALL SELECT workspace_id, index_generation, 'page_coverage_gap', 'warning', (primary_page + 1) || '-' || (nx - 1) FROM g WHERE nx > primary_page + 1
UNION ALL SELECT workspace_id, NULL, 'multiple_generations', 'warning', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT workspace_id, index_generation FROM c) GROUP BY 1 HAVING count(*) > 1""",
)
def validator_set_issues(spark, d):
    c = table(spark, d, "chunks").select("record_id", "workspace_id", "index_generation", "chunk_kind", "file_hash", "primary_page", "chunk_index", "content_hash").distinct()
    return Q.set_issues(c, "workspace_id", "index_generation", "chunk_kind", ["file_hash", "chunk_kind", "primary_page", "chunk_index"], "primary_page", "content_hash")


@query("validator_scan_issues", "WITH f AS (SELECT DISTINCT record_id, workspace_id FROM chunks WHERE index_generation <> 'g0007'), w AS (SELECT DISTINCT workspace_id FROM filings WHERE workspace_id IS NOT NULL) SELECT 'listed_record_not_fetched' AS code, 'error' AS severity, record_id AS subject FROM (SELECT DISTINCT record_id FROM chunks) ANTI JOIN f USING (record_id) UNION ALL SELECT 'workspace_not_found', 'error', workspace_id FROM w ANTI JOIN f USING (workspace_id)")
def validator_scan_issues(spark, d):
    c = table(spark, d, "chunks")
    return Q.scan_issues(c, c.where("index_generation <> 'g0007'"), "record_id", table(spark, d, "filings").where("workspace_id is not null"), "workspace_id")


RECORD_RULES = {
    "missing_required_field": ("error", "coalesce(trim(workspace_id), '') = '' OR coalesce(trim(file_hash), '') = '' OR coalesce(trim(index_generation), '') = ''"),
    "workspace_mismatch": ("error", "workspace_id IS NOT NULL AND substring(workspace_id, 4, 3) <> substring(coalesce(organization_id, ''), 5, 3)"),
    "unknown_canonical_part": ("warning", "chunk_kind IN ('page', 'page_manifest') AND document_part_id = 'unknown'"),
    "record_id_scope_mismatch": ("error", "chunk_kind IN ('page', 'page_manifest') AND NOT contains(record_id, ':' || chunk_kind || ':' || coalesce(CAST(primary_page AS VARCHAR), '?') || ':')"),
    "nonsemantic_page_chunk": ("error", "chunk_kind = 'page' AND regexp_matches(coalesce(trim(chunk_text), ''), '^[0-9]{1,4}$')"),
}


@query("validator_record_rules", "WITH c AS (SELECT DISTINCT record_id, workspace_id, organization_id, file_hash, index_generation, chunk_kind, primary_page, document_part_id, chunk_text FROM chunks) " + " UNION ALL ".join(f"SELECT record_id, '{k}' AS code, '{s}' AS severity FROM c WHERE {x}" for k, (s, x) in RECORD_RULES.items()))
def validator_record_rules(spark, d):
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    paged = F.col("chunk_kind").isin("page", "page_manifest")
    rules = [
        ("missing_required_field", "error", blank("workspace_id") | blank("file_hash") | blank("index_generation")),
        ("workspace_mismatch", "error", F.col("workspace_id").isNotNull() & (F.substring("workspace_id", 4, 3) != F.substring(F.coalesce("organization_id", F.lit("")), 5, 3))),
        ("unknown_canonical_part", "warning", paged & (F.col("document_part_id") == "unknown")),
        ("record_id_scope_mismatch", "error", paged & ~F.contains("record_id", F.concat(F.lit(":"), F.col("chunk_kind"), F.lit(":"), F.coalesce(F.col("primary_page").cast("string"), F.lit("?")), F.lit(":")))),
        ("nonsemantic_page_chunk", "error", (F.col("chunk_kind") == "page") & F.coalesce(F.trim("chunk_text"), F.lit("")).rlike("^[0-9]{1,4}$")),
    ]
    c = table(spark, d, "chunks").select("record_id", "workspace_id", "organization_id", "file_hash", "index_generation", "chunk_kind", "primary_page", "document_part_id", "chunk_text").distinct()
    return Q.issues(c, "record_id", rules)


@query(
    "case_metrics",
    f"""WITH {TRUTH}, m AS (SELECT t.case_id, t.id AS a, p.id AS b, t.type IS NOT DISTINCT FROM p.type AS same, t.s = p.s AND t.e = p.e AS exact FROM t JOIN p ON p.case_id = t.case_id AND p.id = 'seg_' || t.id),
fl AS (SELECT case_id, document_id AS id, max(len(coalesce(flags, []))) AS n FROM annotations WHERE start_page >= 1 AND start_page <= end_page GROUP BY 1, 2),
tt AS (SELECT case_id, count(*) AS expected, count(*) FILTER (n > 0) AS ambiguous FROM t JOIN fl USING (case_id, id) GROUP BY 1), pp AS (SELECT case_id, count(*) AS segments, count(*) FILTER (s % 4 = 0) AS reviewed FROM p GROUP BY 1), mm AS (SELECT case_id, count(*) AS matched, count(*) FILTER (exact) AS exact, count(*) FILTER (same) AS typed FROM m GROUP BY 1),
k AS (SELECT case_id, max(page_count) AS n FROM annotations GROUP BY 1), r AS (SELECT p.case_id, p.id, unnest(range(s, e + 1)) AS page, s % 4 = 0 AS rv FROM p), g AS (SELECT case_id, n, page, count(DISTINCT id) AS slots, bool_or(rv) AS rv FROM r JOIN k USING (case_id) GROUP BY 1, 2, 3),
v AS (SELECT case_id, count(*) FILTER (page BETWEEN 1 AND n) AS owned, count(*) FILTER (page BETWEEN 1 AND n AND slots > 1) AS several, count(*) FILTER (NOT page BETWEEN 1 AND n) AS oor, count(*) FILTER (page BETWEEN 1 AND n AND rv) AS rp FROM g GROUP BY 1)
SELECT case_id, round_even(coalesce(exact, 0) / nullif(coalesce(expected, 0), 0), 6) AS range_accuracy, round_even(coalesce(typed, 0) / nullif(coalesce(matched, 0), 0), 6) AS type_accuracy, round_even(coalesce(reviewed, 0) / nullif(coalesce(segments, 0), 0), 6) AS manual_review_rate, round_even(coalesce(rp, 0) / nullif(n, 0), 6) AS review_page_rate, coalesce(ambiguous, 0) AS ambiguous, n - coalesce(owned, 0) AS missing, coalesce(several, 0) AS several, coalesce(oor, 0) AS out_of_range, coalesce(expected, 0) - coalesce(matched, 0) AS unmatched_true, coalesce(segments, 0) - coalesce(matched, 0) AS unmatched_predicted
FROM k LEFT JOIN tt USING (case_id) LEFT JOIN pp USING (case_id) LEFT JOIN mm USING (case_id) LEFT JOIN v USING (case_id)""",
)
def case_metrics(spark, d):
    """Predictions are matched to the truth by their ids here; ``span_matching`` matches by overlap."""
    t, p = _truth(spark, d), _guess(spark, d).withColumn("needs_review", F.col("start") % 4 == 0)
    a = table(spark, d, "annotations")
    flags = a.where("start_page >= 1 and start_page <= end_page").groupBy("case_id", F.col("document_id").alias("id")).agg(F.max_by("flags", F.size(F.coalesce("flags", F.array().cast("array<string>")))).alias("flags"))
    flags = flags.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    q = p.select("case_id", F.regexp_replace("id", "^seg_", "").alias("id"), F.col("type").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    m = t.join(q, ["case_id", "id"]).select("case_id", F.col("type").eqNullSafe(F.col("_t")).alias("same_type"), ((F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e"))).alias("exact"))
    rows = p.select("case_id", F.explode(F.sequence("start", "end")).alias("page"), F.array("id").alias("slots"), "needs_review")
    return Q.case_metrics(t.select("case_id", "id").join(flags, ["case_id", "id"]), p, m, rows, a.groupBy("case_id").agg(F.max("page_count").alias("page_count")), "case_id")


# ------------------------------------------------------------ retrieval


@query(
    "retrieval_plans",
    """WITH c AS (SELECT check_id, min(quote) FILTER (trim(quote) <> '') AS x, coalesce(list_sort(list_distinct(list(slot_id) FILTER (slot_id IS NOT NULL))), []) AS parts, CASE WHEN CAST(right(check_id, 1) AS INT) % 3 = 0 THEN ['index', 'synopsis'] ELSE ['index'] END AS gone, ['vakalatnama', 'affidavit', 'index'] AS first, CASE WHEN CAST(right(check_id, 1) AS INT) % 2 = 0 THEN ['delay', 'delay', 'sworn'] ELSE [] END AS ph FROM finding_evidence WHERE regexp_matches(check_id, '[0-9]$') GROUP BY check_id),
w AS (SELECT *, list_filter(parts, lambda p: NOT list_contains(gone, p)) AS ws FROM c), t AS (SELECT *, (list_filter(first, lambda p: list_contains(ws, p)) || list_filter(ws, lambda p: NOT list_contains(first, p)))[:4] AS ts, CASE WHEN len(ph) > 0 THEN ' delay sworn' ELSE '' END AS tail FROM w),
e AS (SELECT check_id, unnest(ts) AS part, generate_subscripts(ts, 1) AS place, x, tail, len(ph) AS n FROM t WHERE len(ws) > 0 UNION ALL SELECT check_id, NULL, 1, x, tail, len(ph) FROM t WHERE len(ws) = 0)
SELECT check_id, CAST(place AS INT) AS place, trim(CASE WHEN part IS NULL THEN '' ELSE part || ': ' END || coalesce(x || CASE WHEN tail = '' THEN ' ' ELSE tail END, ltrim(tail))) AS query_text, part, CASE WHEN part = 'application' THEN 'stay' END AS subtype, CASE WHEN n > 0 THEN 'semantic_and_exact' ELSE 'semantic' END AS purpose FROM e""",
)
def retrieval_plans(spark, d):
    digit = F.right("check_id", F.lit(1)).cast("int")
    e = table(spark, d, "finding_evidence").where(F.col("check_id").rlike("[0-9]$"))
    c = e.groupBy("check_id").agg(F.min(F.when(F.trim("quote") != "", F.col("quote"))).alias("x"), F.array_sort(F.collect_set("slot_id")).alias("parts"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    c = c.withColumn("gone", F.when(digit % 3 == 0, words("index", "synopsis")).otherwise(words("index"))).withColumn("first", words("vakalatnama", "affidavit", "index"))
    c = c.withColumn("ph", F.when(digit % 2 == 0, words("delay", "delay", "sworn"))).withColumn("heading", F.lit(None).cast("string")).withColumn("subtype", F.lit("stay"))
    return V.retrieval_plans(c, "check_id", "x", "parts", "gone", "first", "ph", "heading", "subtype")


@query("uncovered_pages", f"WITH {FP}, w AS (SELECT DISTINCT check_id, slot_id AS label FROM finding_evidence WHERE slot_id IN ('affidavit', 'index') AND confidence > 0.9), h AS (SELECT DISTINCT check_id, filing_id, page FROM finding_evidence), p AS (SELECT DISTINCT filing_id, label, page FROM fp) SELECT check_id, filing_id, label, page FROM p JOIN w USING (label) ANTI JOIN h USING (check_id, filing_id, page)")
def uncovered_pages(spark, d):
    e = table(spark, d, "finding_evidence")
    wanted = e.where("slot_id in ('affidavit', 'index') and confidence > 0.9").select("check_id", F.col("slot_id").alias("label"))
    return V.uncovered_pages(wanted, filing_pages(spark, d).select("filing_id", "label", "page").distinct(), e, "check_id", "filing_id", "label").select("check_id", "filing_id", "label", "page")


@query(
    "layout_fallback",
    f"""WITH {PT}, h AS (SELECT check_id, filing_id, page, max(confidence) AS score FROM finding_evidence WHERE page IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2, 3), a AS (SELECT DISTINCT check_id, unnest(['counter-affidavit', 'High Court', 'delay  of', ' ']) AS ph FROM finding_evidence WHERE regexp_matches(check_id, '[02468]$')),
x AS (SELECT DISTINCT filing_id, page, regexp_replace(lower(trim(coalesce(t, ''))), '\\s+', ' ', 'g') AS x FROM pt), n AS (SELECT k.check_id, k.filing_id, x.page, CAST(count(*) AS DOUBLE) AS score FROM (SELECT DISTINCT check_id, filing_id FROM h) k JOIN a USING (check_id) JOIN x USING (filing_id) WHERE trim(ph) <> '' AND contains(x.x, regexp_replace(lower(trim(ph)), '\\s+', ' ', 'g')) GROUP BY 1, 2, 3),
u AS (SELECT *, 'search' AS origin FROM h UNION ALL SELECT n.*, 'layout' FROM n ANTI JOIN h USING (check_id, filing_id, page)) SELECT check_id, filing_id, page, origin, score FROM u QUALIFY row_number() OVER (PARTITION BY check_id, filing_id ORDER BY origin = 'layout', score DESC, page) <= 6""",
)
def layout_fallback(spark, d):
    e = table(spark, d, "finding_evidence")
    hits = e.where("page is not null and confidence is not null").select("check_id", "filing_id", "page", F.col("confidence").alias("score"))
    phrases = F.array(*[F.lit(x) for x in ("counter-affidavit", "High Court", "delay  of", " ")])
    anchors = e.where(F.col("check_id").rlike("[02468]$")).select("check_id", F.explode(phrases).alias("phrase")).distinct()
    return V.layout_fallback(hits, scanned(spark, d).select("filing_id", "page", "t").distinct(), anchors, "check_id", "filing_id", "t", 6)


@query(
    "followed_up",
    f"WITH {ALL}, p AS (SELECT q.query_id, l.label FROM q, (SELECT DISTINCT label FROM embeddings WHERE label % 2 = 0) l), o AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY rank, vec_id) AS n FROM t SEMI JOIN p USING (query_id, label)), f AS (SELECT * FROM o WHERE n <= 8 AND vec_id % 3 <> 0) SELECT query_id, label, vec_id, score, rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, vec_id) <= 4",
)
def followed_up(spark, d):
    hits = unscoped(spark, d)
    parts = asked(spark, d).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(200), F.lit(2))).alias("label"))
    return V.followed_up(hits, hits.where("vec_id % 3 = 0"), parts, "query_id", "vec_id", "label", 4)


# ------------------------------------------------------------ marks, pages, fields, needs


@query("parsed_marks", f"WITH {FE}, m AS (SELECT evidence_id, 'signature' AS kind, CASE WHEN slot_id IS NULL OR trim(slot_id) = '' THEN 'unknown' ELSE lower(trim(slot_id)) END AS role, confidence AS x, 0.5 AS y, 0.25 AS w, CASE WHEN page % 5 = 0 THEN 0.75 ELSE 0.5 END AS h, page FROM fe) SELECT DISTINCT evidence_id, kind, role, x, y, w, h FROM m WHERE x BETWEEN 0 AND 1 AND x + w <= 1 AND y + h <= 1 AND page % 7 <> 0")
def parsed_marks(spark, d):
    """Answers as arrays, as objects or fenced; every seventh page's answer isn't JSON."""
    e = table(spark, d, "finding_evidence").where("page is not null")
    mark = F.to_json(F.array(F.struct(F.lit(" Signature ").alias("type"), F.col("slot_id").alias("role"), F.col("confidence").alias("x"), F.lit(0.5).alias("y"), F.lit(0.25).alias("w"), F.when(F.col("page") % 5 == 0, 0.75).otherwise(0.5).alias("h"))))
    answer = F.when(F.col("page") % 7 == 0, F.lit("no marks here")).when(F.col("page") % 3 == 0, F.concat(F.lit('{"marks":'), mark, F.lit("}"))).when(F.col("page") % 3 == 1, F.concat(F.lit("```json\n"), mark, F.lit("\n```"))).otherwise(mark)
    return R.parsed_marks(e.withColumn("answer", answer), ["evidence_id"], "answer").distinct()


@query("local_pages", f"WITH {FP}, l AS (SELECT filing_id, slot_id, page, row_number() OVER (PARTITION BY filing_id, slot_id ORDER BY page) AS local FROM (SELECT DISTINCT filing_id, slot_id, page FROM fp)), e AS (SELECT DISTINCT evidence_id, filing_id, unnest([page, page + 1, page]) AS page FROM finding_evidence WHERE page IS NOT NULL) SELECT evidence_id, slot_id, list(DISTINCT local ORDER BY local) AS pages FROM e JOIN l USING (filing_id, page) GROUP BY 1, 2")
def local_pages(spark, d):
    p = filing_pages(spark, d).select("filing_id", "slot_id", "page").distinct()
    layout = p.withColumn("local_page", F.row_number().over(Window.partitionBy("filing_id", "slot_id").orderBy("page")))
    e = table(spark, d, "finding_evidence").where("page is not null").withColumn("pages", F.array("page", F.col("page") + 1, "page"))
    return R.local_pages(e, layout, "evidence_id", ["filing_id"], "pages", "slot_id")


@query("key_fields", "WITH f AS (SELECT DISTINCT filing_id, court, petition_type, cause_title FROM filings), r AS (SELECT filing_id, 'title' AS field, nullif(trim(cause_title.formatted_title), '') AS a, nullif(trim(cause_title.title), '') AS b, 'cause_title.formatted_title' AS pa, 'cause_title.title' AS pb FROM f UNION ALL SELECT filing_id, 'court', nullif(trim(court), ''), NULL, 'court', NULL FROM f UNION ALL SELECT filing_id, 'kind', NULL, nullif(trim(petition_type), ''), 'kind', 'petition_type' FROM f) SELECT DISTINCT filing_id, field, coalesce(a, b) AS value, CASE WHEN a IS NOT NULL THEN pa WHEN b IS NOT NULL THEN pb END AS source FROM r")
def key_fields(spark, d):
    f = table(spark, d, "filings").select("filing_id", F.to_json(F.struct("court", "petition_type", "cause_title")).alias("j"))
    return R.key_fields(f, "filing_id", "j", {"title": ["cause_title.formatted_title", "cause_title.title"], "court": ["court"], "kind": ["kind", "petition_type"]}).distinct()


@query("needs_of_checks", f"WITH {FE}, n AS (SELECT evidence_id, 'signature' AS need, 'vakalatnama' AS part FROM fe WHERE contains(lower(coalesce(quote, '')), 'signature') UNION ALL SELECT evidence_id, 'stamp', slot_id FROM fe WHERE regexp_matches(lower(coalesce(quote, '')), 'certified cop|seal')) SELECT DISTINCT * FROM n")
def needs_of_checks(spark, d):
    e = table(spark, d, "finding_evidence").withColumn("parts", F.when(F.col("slot_id").isNotNull(), F.array("slot_id")))
    return R.needs_of(e, "evidence_id", "quote", "parts", [("signature", "signature", "vakalatnama"), ("stamp", "certified cop|seal", "")])


@query("restored_artifacts", "SELECT DISTINCT filing_id, cause_title.title AS title, cause_title.main_petitioner AS petitioner, CAST(len(petitioners) AS INT) AS n FROM filings")
def restored_artifacts(spark, d):
    f = table(spark, d, "filings")
    r = f.select("filing_id", R.restored(f, "cause_title").alias("c"), R.restored(f, "petitioners").alias("p"))
    return r.select("filing_id", F.col("c.title").alias("title"), F.col("c.main_petitioner").alias("petitioner"), F.when(F.col("p").isNotNull(), F.size("p")).alias("n")).distinct()


@query("first_existing_id", "WITH c AS (SELECT DISTINCT record_id, file_hash, primary_page, chunk_index FROM chunks WHERE file_hash IS NOT NULL AND primary_page IS NOT NULL), x AS (SELECT record_id FROM chunks WHERE chunk_kind = 'page' AND ocr_status = 'ocr'), k AS (SELECT file_hash, record_id, primary_page * 1000 + coalesce(chunk_index, 0) AS p FROM c WHERE record_id IN (SELECT record_id FROM x)) SELECT file_hash, record_id FROM k QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY p, record_id) = 1")
def first_existing_id(spark, d):
    c = table(spark, d, "chunks")
    candidates = c.where("file_hash is not null and primary_page is not null").select("file_hash", "record_id", (F.col("primary_page") * 1000 + F.coalesce("chunk_index", F.lit(0))).alias("p")).distinct()
    return R.first_existing_id(candidates, c.where("chunk_kind = 'page' and ocr_status = 'ocr'"), "file_hash", "record_id", "p")


@query("enveloped_records", f"WITH {FE} SELECT DISTINCT evidence_id, quote AS value, CASE WHEN quote IS NOT NULL AND confidence BETWEEN 0 AND 1 THEN confidence END AS confidence, CASE WHEN quote IS NOT NULL THEN CASE WHEN page IS NULL THEN [] ELSE [page, page + 1] END END AS pages FROM fe")
def enveloped_records(spark, d):
    e = table(spark, d, "finding_evidence").distinct()
    pages = F.array(F.col("page") + 1, "page", F.col("page") + 1, F.lit(None).cast("int"))
    x = R.enveloped(e, ["evidence_id"], {"quote": (F.col("quote"), F.col("confidence"), pages)})
    return x.select("evidence_id", "quote.value", "quote.confidence", "quote.pages").distinct()


@query("severity_counts", "WITH RECURSIVE c AS (SELECT DISTINCT record_id, workspace_id, chunk_kind, chunk_text, vector_schema_version FROM chunks), f AS (SELECT workspace_id, 'error' AS severity FROM c WHERE vector_schema_version IS DISTINCT FROM 4 UNION ALL SELECT workspace_id, 'warning' FROM c WHERE chunk_text IS NOT NULL AND length(chunk_text) < 40) SELECT workspace_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) AS flags, count(*) FILTER (severity = 'error') = 0 AS passed FROM f GROUP BY 1")
def severity_counts(spark, d):
    c = table(spark, d, "chunks").select("record_id", "workspace_id", "chunk_kind", "chunk_text", "vector_schema_version").distinct()
    flags = c.where("not vector_schema_version <=> 4").select("workspace_id", F.lit("error").alias("severity")).unionByName(c.where("chunk_text is not null and length(chunk_text) < 40").select("workspace_id", F.lit("warning").alias("severity")))
    return R.severity_counts(flags, ["workspace_id"], ["error", "warning"])
