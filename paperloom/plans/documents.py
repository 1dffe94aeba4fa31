"""Queries of page reading, label repair and reconciliation."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import documents as D
from ..session import table
from .pages import FP, PT, filing_pages, scanned
from .relations import FE, evidence

TYPES = [("(?m)^ANNEXURE", "annexure", 0.9), ("(?m)^Synopsis and List of Dates", "synopsis", 0.85), ("(?m)^Written Submissions", "submissions", 0.8)]
TYPE_SQL = "CASE WHEN regexp_matches(coalesce(t, ''), '(?m)^ANNEXURE') THEN {0} WHEN regexp_matches(coalesce(t, ''), '(?m)^Synopsis and List of Dates') THEN {1} WHEN regexp_matches(coalesce(t, ''), '(?m)^Written Submissions') THEN {2} ELSE {3} END"


@query("page_types", f"WITH {PT}, h AS (SELECT *, CASE WHEN page % 3 = 0 THEN 'synopsis' END AS hint, {TYPE_SQL.format(chr(39) + 'annexure' + chr(39), chr(39) + 'synopsis' + chr(39), chr(39) + 'submissions' + chr(39), 'NULL')} AS k, {TYPE_SQL.format(0.9, 0.85, 0.8, 0.0)} AS c FROM pt) SELECT page_id, coalesce(k, hint, 'other') AS type, round_even(CASE WHEN k IS NULL AND hint IS NOT NULL THEN 0.58 WHEN hint = k THEN least(c + 0.05, 1.0) ELSE c END, 3) AS confidence FROM h")
def page_types(spark, d):
    p = scanned(spark, d).withColumn("hint", F.when(F.col("page") % 3 == 0, "synopsis"))
    return D.classified(p, "t", TYPES, "hint").select("page_id", "type", "confidence")


@query("table_rows", "WITH c AS (SELECT DISTINCT record_id, chunk_text FROM chunks WHERE chunk_text IS NOT NULL), l AS (SELECT record_id, unnest(string_split(chunk_text, chr(10))) AS line, generate_subscripts(string_split(chunk_text, chr(10)), 1) AS line_no FROM c), x AS (SELECT record_id, line_no, list_transform(string_split(trim(line, '| '), '|'), lambda v: trim(v)) AS c FROM l WHERE contains(line, '|')) SELECT record_id, CAST(line_no AS INT) AS line_no, c[1] AS serial, c[2] AS dated, c[3] AS item, c[4] AS amount, c[5] AS place FROM x WHERE len(c) = 5 AND regexp_matches(c[1], '^[0-9]{1,4}\\.?$')")
def table_rows(spark, d):
    c = table(spark, d, "chunks").where("chunk_text is not null").select("record_id", "chunk_text").distinct()
    return D.table_rows(c, ["record_id"], "chunk_text", ["serial", "dated", "item", "amount", "place"])


FORMS = [("page_of", r"(?i)^page\s+([0-9]{1,5})\s+of\s+[0-9]{1,5}$"), ("page_no", r"(?i)^(?:pg|page)\.?\s*(?:no\.?)?\s*([0-9]{1,5})$"), ("dashed", r"^[-—–\[(]\s*([0-9]{1,5})\s*[-—–\])]$"), ("bare", "^([0-9]{1,5})$")]
FOLIO_CASE = "CASE " + " ".join(f"WHEN regexp_matches(ls[{i}], '{p}') THEN {{'folio': CAST(regexp_extract(ls[{i}], '{p}', 1) AS INT), 'form': '{f}'}}" for f, p in FORMS for i in (-1, 1)) + " END"


@query("printed_folios", f"WITH {PT}, l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pt), f AS (SELECT page_id, {FOLIO_CASE} AS f FROM l WHERE len(ls) > 0) SELECT page_id, f.folio AS folio, f.form AS form FROM f WHERE f IS NOT NULL")
def printed_folios(spark, d):
    return D.printed_folios(scanned(spark, d), ["page_id"], "t")


@query("heading_segments", f"WITH {PT}, l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM pt), h AS (SELECT *, regexp_matches(line, '^(ANNEXURE|IN THE|Synopsis|Written)') AS h FROM l), k AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY page_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM h), s AS (SELECT page_id, k, trim(arg_min(line, n)) AS label, trim(coalesce(string_agg(trim(line), ' ' ORDER BY n) FILTER (NOT h), '')) AS particulars FROM k WHERE k > 0 GROUP BY 1, 2) SELECT page_id, label, particulars FROM s QUALIFY row_number() OVER (PARTITION BY page_id, label ORDER BY k) = 1")
def heading_segments(spark, d):
    return D.heading_segments(scanned(spark, d), ["page_id"], "t", "^(ANNEXURE|IN THE|Synopsis|Written)")


@query("label_propagation", f"WITH {PT}, s AS (SELECT page_id, filing_id, page, CASE WHEN length(coalesce(t, '')) % 4 = 0 THEN 'P-' || page END AS stamp FROM pt) SELECT page_id, coalesce(last_value(stamp IGNORE NULLS) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING), first_value(stamp IGNORE NULLS) OVER (PARTITION BY filing_id ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS label FROM s")
def label_propagation(spark, d):
    p = scanned(spark, d).withColumn("stamp", F.when(F.length(F.coalesce("t", F.lit(""))) % 4 == 0, F.concat(F.lit("P-"), F.col("page").cast("string"))))
    return D.propagated_labels(p, "filing_id", "page", "stamp").select("page_id", "label")


@query("anchor_phrases")
def anchor_phrases(spark, d):
    return evidence(spark, d).select("evidence_id", D.anchor_phrases("quote", ["delay", "High Court"]).alias("phrases"))


FIELDS = [("appeal", "(?i)preferred", r"((?:Civil|Crl\.) Appeal No\. \d+ of \d{4})"), ("clause", "(?i)bare reading", r"clause (\d+)")]


@query("first_fields", f"WITH {PT}, h AS (SELECT filing_id, page, 'appeal' AS field, regexp_extract(t, '((Civil|Crl\\.) Appeal No\\. [0-9]+ of [0-9]{{4}})', 1) AS value, CASE WHEN regexp_matches(t, '(?i)preferred') THEN 0 ELSE 1 END AS rank FROM pt WHERE regexp_matches(t, '(Civil|Crl\\.) Appeal No\\. [0-9]+ of [0-9]{{4}}') UNION ALL SELECT filing_id, page, 'clause', regexp_extract(t, 'clause ([0-9]+)', 1), CASE WHEN regexp_matches(t, '(?i)bare reading') THEN 0 ELSE 1 END FROM pt WHERE regexp_matches(t, 'clause [0-9]+')) SELECT filing_id, field, value, page FROM h QUALIFY row_number() OVER (PARTITION BY filing_id, field ORDER BY rank, page) = 1")
def first_fields(spark, d):
    return D.first_fields(scanned(spark, d), ["filing_id"], "page", "t", FIELDS)


@query("named_categories", f"WITH {FE}, h AS (SELECT evidence_id, instr(coalesce(quote, ''), 'consent') AS pos, 'consent' AS category FROM fe UNION ALL SELECT evidence_id, instr(coalesce(quote, ''), 'limitation'), 'limitation' FROM fe UNION ALL SELECT evidence_id, instr(coalesce(quote, ''), 'Court'), 'court' FROM fe) SELECT evidence_id, category, CAST(row_number() OVER (PARTITION BY evidence_id ORDER BY pos) AS INT) AS place FROM h WHERE pos > 0 QUALIFY place <= 2")
def named_categories(spark, d):
    return D.named_categories(evidence(spark, d), ["evidence_id"], "quote", [("consent", "consent"), ("limitation", "limitation"), ("Court", "court")], 2)


@query("flatten_nested", "SELECT event_id, 'a.b.k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'a.l', '[1,2]' FROM events UNION ALL SELECT event_id, 't', event_type FROM events")
def flatten_nested(spark, d):
    e = table(spark, d, "events")
    payload = F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit(', "l": [1,2]}, "t": "'), F.col("event_type"), F.lit('"}'))
    return D.flattened_json(e.select("event_id", payload.alias("p")), ["event_id"], "p")


@query(
    "pruned_records",
    """WITH f AS (SELECT DISTINCT filing_id, nullif(trim(court), '') IS NOT NULL AS c, cause_title.title AS t, cause_title.formatted_title AS ft, list_filter(list_transform(coalesce(advocates_on_record, []), lambda a: a.email), lambda e: trim(e) <> '') AS mails, len(list_filter(coalesce(advocates_on_record, []), lambda a: coalesce(trim(a.name), '') <> '' OR coalesce(trim(a.registration_number), '') <> '' OR coalesce(trim(a.email), '') <> '' OR coalesce(trim(a.mobile), '') <> '' OR coalesce(trim(a.firm), '') <> '' OR coalesce(trim(a.office_address), '') <> '')) AS n FROM filings)
SELECT DISTINCT filing_id, c AS has_court, CASE WHEN trim(t) <> '' THEN t END AS title, CASE WHEN trim(ft) <> '' THEN ft END AS formatted, CASE WHEN n > 0 THEN CAST(n AS BIGINT) END AS advocates, CAST(len(mails) AS BIGINT) AS mails FROM f""",
)
def pruned_records(spark, d):
    f = table(spark, d, "filings")
    j = f.select("filing_id", D.pruned(f, ["court", "petition_type", "cause_title", "advocates_on_record"]).alias("j")).distinct()
    at = lambda p: F.get_json_object("j", p)
    mails = F.size(F.regexp_extract_all("j", F.lit('"email":'), F.lit(0)))
    return j.select("filing_id", at("$.court").isNotNull().alias("has_court"), at("$.cause_title.title").alias("title"), at("$.cause_title.formatted_title").alias("formatted"), F.json_array_length(at("$.advocates_on_record")).cast("bigint").alias("advocates"), mails.cast("bigint").alias("mails")).distinct()


@query("output_selection", f"WITH {FP} SELECT DISTINCT filing_id, slot_id, label NOT IN ('index', 'synopsis', 'affidavit', 'vakalatnama') AS excluded FROM fp")
def output_selection(spark, d):
    p = filing_pages(spark, d).select("filing_id", "slot_id", "label").distinct()
    return D.selected(p, "label", "Index; synopsis|sworn", {"sworn": ["affidavit", "vakalatnama"]}).select("filing_id", "slot_id", "excluded")


@query("island_scores")
def island_scores(spark, d):
    pages = scanned(spark, d).where("t is not null").select("filing_id", F.col("page").alias("island"), "t")
    e = evidence(spark, d).where("quote is not null").select("filing_id", F.col("check_id").alias("label"), "quote")
    return D.island_scores(pages, e, "filing_id", "label", "t", "quote", T.date_keys, T.case_numbers)


REP = f"{FP}, o AS (SELECT filing_id, page, CASE WHEN page % 4 = 0 THEN NULL ELSE min(label) END AS label, page % 7 = 1 AS weak FROM fp GROUP BY 1, 2)"


@query(
    "repaired_labels",
    f"""WITH {REP}, x AS (SELECT *, last_value(CASE WHEN label IS NOT NULL THEN page END IGNORE NULLS) OVER a AS bp, last_value(label IGNORE NULLS) OVER a AS bl, first_value(CASE WHEN label IS NOT NULL THEN page END IGNORE NULLS) OVER z AS ap, first_value(label IGNORE NULLS) OVER z AS al FROM o
 WINDOW a AS (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY filing_id ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT filing_id, page, weak, CASE WHEN label IS NULL AND bl = al AND ap - bp - 1 <= 2 THEN bl ELSE label END AS label FROM x), w AS (SELECT *, lag(label) OVER v AS p, lead(label) OVER v AS n FROM y WINDOW v AS (PARTITION BY filing_id ORDER BY page))
SELECT filing_id, page, CASE WHEN coalesce(weak AND p = n AND p <> label, false) THEN p ELSE label END AS label FROM w""",
)
def repaired_labels(spark, d):
    pages = _weak(spark, d)
    passes = [lambda m: D.bridged(m, "filing_id", "page", "label"), lambda m: D.smoothed(m, "filing_id", "page", "label")]
    return D.repaired_labels(pages, passes).select("filing_id", "page", "label")


def _weak(spark, d):
    pages = filing_pages(spark, d).groupBy("filing_id", "page").agg(F.min("label").alias("label"))
    return pages.withColumn("label", F.when(F.col("page") % 4 != 0, F.col("label"))).withColumn("weak", F.col("page") % 7 == 1)


@query(
    "reconciled_labels",
    f"""WITH {REP}, x AS (SELECT *, CASE WHEN page % 2 = 0 THEN 'annexures' ELSE CASE WHEN page % 5 = 1 THEN 'annexures' END END AS pr FROM o), m AS (SELECT *, pr IS NOT NULL AND (label IS NULL OR weak) AS may FROM x),
g AS (SELECT *, CASE WHEN coalesce(may AND lag(may) OVER w AND lag(pr) OVER w = pr, false) THEN 0 ELSE 1 END AS fresh, may AND (label IS NULL OR label = pr OR coalesce(lag(label) OVER w = pr, false) OR coalesce(lead(label) OVER w = pr, false)) AS seed FROM m WINDOW w AS (PARTITION BY filing_id ORDER BY page)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY filing_id ORDER BY page) AS chain FROM g) SELECT filing_id, page, CASE WHEN may AND bool_or(seed) OVER (PARTITION BY filing_id, chain) THEN pr ELSE label END AS label FROM c""",
)
def reconciled_labels(spark, d):
    proposed = F.when((F.col("page") % 2 == 0) | (F.col("page") % 5 == 1), F.lit("annexures"))
    return D.reconciled(_weak(spark, d).withColumn("proposed", proposed), "filing_id", "page", "label", "proposed").select("filing_id", "page", "label")


@query("source_transitions", f"WITH {FP}, o AS (SELECT filing_id, page, min(label) AS h FROM fp GROUP BY 1, 2), x AS (SELECT *, lag(h) OVER w AS before, lag(h, 2) OVER w AS b2, lead(h) OVER w AS n FROM o WINDOW w AS (PARTITION BY filing_id ORDER BY page)) SELECT filing_id, page, before, h AS \"after\" FROM x WHERE before = b2 AND h = n AND before <> h")
def source_transitions(spark, d):
    pages = filing_pages(spark, d).groupBy("filing_id", "page").agg(F.min("label").alias("h"))
    return D.source_transitions(pages, "filing_id", "page", "h")


@query(
    "selected_pages",
    f"""WITH {PT}, r AS (SELECT page_id, filing_id, page, t, row_number() OVER (PARTITION BY filing_id ORDER BY page) AS a, row_number() OVER (PARTITION BY filing_id ORDER BY page DESC) AS b, count(*) OVER (PARTITION BY filing_id) AS n FROM pt), q AS (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY page DESC) AS k FROM r WHERE contains(lower(coalesce(t, '')), 'counter-affidavit'))
SELECT 'all' AS selector, page_id, CASE WHEN a = 1 THEN 100 ELSE 80 END AS priority FROM r UNION ALL SELECT 'first', page_id, 100 FROM r WHERE a = 1 UNION ALL SELECT 'last', page_id, CASE WHEN a = 1 THEN 100 ELSE 80 END FROM r WHERE b = 1 UNION ALL SELECT 'first_last', page_id, CASE WHEN a = 1 THEN 100 ELSE 80 END FROM r WHERE a = 1 OR b = 1
UNION ALL SELECT 'all_short', page_id, CASE WHEN a = 1 THEN 100 ELSE 80 END FROM r WHERE n <= 3 UNION ALL SELECT 'cues', page_id, 90 FROM q WHERE k <= 2""",
)
def selected_pages(spark, d):
    """All six selectors."""
    pages, cue = scanned(spark, d), F.contains(F.lower(F.coalesce("t", F.lit(""))), F.lit("counter-affidavit"))
    out = None
    for name in ("all", "first", "last", "first_last", "all_short", "cues"):
        one = D.selected_pages(pages, "filing_id", "page", name, cue).select(F.lit(name).alias("selector"), "page_id", "priority")
        out = one if out is None else out.unionByName(one)
    return out


@query("marks_for_needs", f"WITH {FE}, {FP} SELECT DISTINCT evidence_id, label FROM (SELECT * FROM fe WHERE page IS NOT NULL) e JOIN fp ON e.filing_id = fp.filing_id AND e.page = fp.page WHERE (boxes_status = 'matched' AND label IN ('affidavit', 'vakalatnama')) OR (boxes_status = 'partial' AND label = 'annexures')")
def marks_for_needs(spark, d):
    needs = spark.createDataFrame([("matched", "affidavit"), ("matched", "vakalatnama"), ("partial", "annexures")], "boxes_status string, label string")
    return D.marks_for_needs(evidence(spark, d), needs, "boxes_status", filing_pages(spark, d), "filing_id").select("evidence_id", "label").distinct()


@query("missing_slots", "WITH f AS (SELECT DISTINCT filing_id, regexp_replace(slot_id, '_[0-9]+$', '') AS slot_id FROM filing_parts WHERE slot_id IS NOT NULL) SELECT filing_id, slot AS slot_id FROM (SELECT DISTINCT filing_id FROM f), (VALUES ('index'), ('main_petition'), ('vakalatnama')) v(slot) WHERE (filing_id, slot) NOT IN (SELECT (filing_id, slot_id) FROM f)")
def missing_slots(spark, d):
    parts = table(spark, d, "filing_parts").where("slot_id is not null").select("filing_id", F.regexp_replace("slot_id", "_[0-9]+$", "").alias("slot_id"))
    required = spark.createDataFrame([("index",), ("main_petition",), ("vakalatnama",)], "slot string")
    return D.required_slots(parts, "filing_id", "slot_id", required)


ONE = f"{FP}, o AS (SELECT filing_id, page, min(slot_id) AS label FROM fp GROUP BY 1, 2)"


def _owners(spark, d):
    return filing_pages(spark, d).groupBy("filing_id", "page").agg(F.min("slot_id").alias("label"))


@query("anchored_labels", f"WITH {ONE} SELECT filing_id, page, coalesce(last_value(CASE WHEN page % 3 = 1 THEN label END IGNORE NULLS) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING), label) AS label FROM o")
def anchored_labels(spark, d):
    return D.anchored(_owners(spark, d), "filing_id", "page", "label", F.col("page") % 3 == 1)


@query(
    "absorbed_runs",
    f"""WITH {ONE}, a AS (SELECT filing_id, page, CASE WHEN page % 5 = 0 THEN 'stray' ELSE label END AS label FROM o), c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY filing_id ORDER BY page) = label THEN 0 ELSE 1 END AS c FROM a),
r AS (SELECT *, sum(c) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM c), g AS (SELECT filing_id, run, count(*) AS n, any_value(label) AS l FROM r GROUP BY 1, 2), h AS (SELECT *, lag(l) OVER w AS p, lead(l) OVER w AS q FROM g WINDOW w AS (PARTITION BY filing_id ORDER BY run))
SELECT filing_id, page, CASE WHEN n <= 1 AND p = q THEN p ELSE label END AS label FROM r JOIN h USING (filing_id, run)""",
)
def absorbed_runs(spark, d):
    pages = _owners(spark, d).withColumn("label", F.when(F.col("page") % 5 == 0, "stray").otherwise(F.col("label")))
    return D.absorbed(pages, "filing_id", "page", "label")


@query("rising_numbers", f"WITH {ONE}, n AS (SELECT *, TRY_CAST(regexp_extract(label, '_([0-9]+)$', 1) AS INT) AS n FROM o) SELECT filing_id, page, CASE WHEN n IS NULL THEN label ELSE (max(CASE WHEN n IS NOT NULL THEN {{'n': n, 'l': label}} END) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING)).l END AS label FROM n")
def rising_numbers(spark, d):
    number = F.regexp_extract("label", "_([0-9]+)$", 1).try_cast("int")
    return D.rising_numbers(_owners(spark, d), "filing_id", "page", "label", number)


@query(
    "bracketed_labels",
    f"""WITH {REP}, e AS (SELECT filing_id, page, min(label) AS part FROM (SELECT filing_id, label, min(page) AS page FROM fp GROUP BY 1, 2) GROUP BY 1, 2), x AS (SELECT o.*, (SELECT arg_max(part, e.page) FROM e WHERE e.filing_id = o.filing_id AND e.page <= o.page) AS held FROM o) SELECT filing_id, page, CASE WHEN held IS NOT NULL AND (label IS NULL OR weak) THEN held ELSE label END AS label FROM x""",
)
def bracketed_labels(spark, d):
    entries = filing_pages(spark, d).groupBy("filing_id", F.col("label").alias("part")).agg(F.min("page").alias("start"))
    return D.bracketed(_weak(spark, d), "filing_id", "page", "label", entries).select("filing_id", "page", "label")


@query(
    "reopened_labels",
    f"""WITH {REP}, h AS (SELECT *, CASE WHEN page % 6 = 0 THEN 'certificate' END AS hd FROM o), x AS (SELECT *, last_value(CASE WHEN hd IS NOT NULL THEN hd WHEN label IS NOT NULL AND NOT weak THEN '' END IGNORE NULLS) OVER (PARTITION BY filing_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS l FROM h) SELECT filing_id, page, CASE WHEN l <> '' THEN l ELSE label END AS label FROM x""",
)
def reopened_labels(spark, d):
    pages = _weak(spark, d).withColumn("heading", F.when(F.col("page") % 6 == 0, F.lit("certificate")))
    return D.reopened(pages, "filing_id", "page", "label", "heading").select("filing_id", "page", "label")


@query(
    "sole_runs",
    f"""WITH {REP}, r AS (SELECT filing_id, page, label, page - row_number() OVER (PARTITION BY filing_id, label ORDER BY page) AS run FROM o WHERE label IS NOT NULL), g AS (SELECT filing_id, label, run, count(*) AS n, min(page) AS s FROM r GROUP BY 1, 2, 3), q AS (SELECT *, max(n) OVER (PARTITION BY filing_id, label) AS m, row_number() OVER (PARTITION BY filing_id, label ORDER BY s) AS k FROM g),
x AS (SELECT filing_id, label, run FROM q WHERE n < 2 AND NOT (m < 2 AND k = 1)), l AS (SELECT filing_id, page FROM r SEMI JOIN x USING (filing_id, label, run)) SELECT o.filing_id, o.page, CASE WHEN l.page IS NULL THEN o.label END AS label FROM o LEFT JOIN l ON o.filing_id = l.filing_id AND o.page = l.page""",
)
def sole_runs(spark, d):
    return D.sole_runs(_weak(spark, d), "filing_id", "page", "label").select("filing_id", "page", "label")


WT = "w AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS word, l_discount * 9 AS x, l_linenumber // 2 * 0.1 + l_tax / 20 AS y, l_quantity / 100 AS w, 0.02 AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_linenumber // 2 AS line FROM lineitem)"


def _table_words(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    line = F.floor(F.col("l_linenumber") / 2)
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("word"), (F.col("l_discount") * 9).alias("x"), (line * 0.1 + F.col("l_tax") / 20).alias("y"), (F.col("l_quantity") / 100).alias("w"), F.lit(0.02).alias("h"), place.alias("place"), line.alias("line"))


@query(
    "word_tables",
    f"""WITH {WT}, a AS (SELECT *, coalesce(CAST(y - lag(y) OVER v >= 0.01 AS INT), 1) AS fresh FROM w WINDOW v AS (PARTITION BY l_orderkey ORDER BY y, x, word)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY y, x, word ROWS UNBOUNDED PRECEDING) AS row FROM a)
SELECT l_orderkey, CAST(row AS BIGINT) AS row, [coalesce(string_agg(word, ' ' ORDER BY x, word) FILTER (x < 0.3), ''), coalesce(string_agg(word, ' ' ORDER BY x, word) FILTER (x >= 0.3 AND x < 0.6), ''), coalesce(string_agg(word, ' ' ORDER BY x, word) FILTER (x >= 0.6), '')] AS cells FROM b GROUP BY 1, 2""",
)
def word_tables(spark, d):
    return D.word_table(_table_words(spark, d), ["l_orderkey"], [0.0, 0.3, 0.6])


@query("quote_boxes", f"WITH {WT}, m AS (SELECT l_orderkey AS id, l_orderkey, 2 AS a, 5 AS b FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3), j AS (SELECT id, l_orderkey, line, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b FROM m JOIN w USING (l_orderkey) WHERE place BETWEEN m.a AND m.b GROUP BY 1, 2, 3) SELECT id, l_orderkey, line, x, y, round_even(r - x, 6) AS w, round_even(b - y, 6) AS h FROM j")
def quote_boxes(spark, d):
    words = _table_words(spark, d)
    m = words.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 3").select(F.col("l_orderkey").alias("id"), "l_orderkey", F.lit(2).alias("first"), F.lit(5).alias("last"))
    return D.quote_boxes(m, words, "id", ["l_orderkey"])


@query(
    "description_sources",
    """WITH c AS (SELECT DISTINCT file_hash, record_id, document_part_id AS part, primary_page AS page, chunk_text AS t FROM chunks WHERE file_hash IS NOT NULL AND document_part_id IS NOT NULL), w AS (SELECT DISTINCT file_hash, part AS label FROM c WHERE part IN ('affidavit', 'certificate', 'application')), b AS (SELECT w.label, c.* FROM w JOIN c USING (file_hash)),
n AS (SELECT *, 'synopsis' AS source, 1 AS most FROM b WHERE part = 'synopsis' AND contains(lower(coalesce(t, '')), lower(label)) UNION ALL SELECT *, 'own', 3 FROM b WHERE part = label), k AS (SELECT *, row_number() OVER (PARTITION BY file_hash, label, source ORDER BY page NULLS LAST, record_id) AS k FROM n)
SELECT file_hash, label, row_number() OVER (PARTITION BY file_hash, label ORDER BY source DESC, k) AS place, record_id, source FROM k WHERE k <= most""",
)
def description_sources(spark, d):
    c = table(spark, d, "chunks").where("file_hash is not null and document_part_id is not null").select("file_hash", "record_id", F.col("document_part_id").alias("part"), F.col("primary_page").alias("page"), F.col("chunk_text").alias("text")).distinct()
    return D.description_sources(c.where("part in ('affidavit', 'certificate', 'application')").select("file_hash", F.col("part").alias("label")), c, "file_hash", "label")
