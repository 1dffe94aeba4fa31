"""Queries of the column functions."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..session import table
from .relations import FE, evidence

PARTIES = "pa AS (SELECT DISTINCT filing_id, u.name AS name, u.kind AS kind, u.confidence AS confidence FROM (SELECT filing_id, unnest(petitioners) AS u FROM filings))"


def parties(spark, d):
    return table(spark, d, "filings").select("filing_id", F.explode("petitioners").alias("u")).select("filing_id", "u.name", "u.kind", "u.confidence").distinct()


@query("whitespace_fold", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM documents")
def whitespace_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.folded("text").cast("binary")).alias("h"))


@query(
    "clean_markup",
    """WITH r AS (SELECT doc_id, '# **Title** &amp; more<br/>' || chr(10) || chr(10) || chr(10) || '<p>' || text || '</p>  end' AS t FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '<br\\s*/?>', chr(10), 'gi'), '<[A-Za-z/][^>]*>', '', 'g') AS t FROM r), b AS (SELECT doc_id, replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{1,6} +', '', 'g'), '\\*\\*|__', '', 'g'), '[ \\t]+', ' ', 'g') AS t FROM b) SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS h FROM c""",
)
def clean_markup(spark, d):
    t = F.concat(F.lit("# **Title** &amp; more<br/>\n\n\n<p>"), F.col("text"), F.lit("</p>  end"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.clean_markup(t).cast("binary")).alias("h"))


@query("quote_fold", f"WITH {FE}, x AS (SELECT evidence_id, translate(lower(quote), '‘’“”–—', '''''\"\"--') AS t FROM fe WHERE quote IS NOT NULL) SELECT evidence_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<[a-z/][^>]*>', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\.\\.\\.|…', ' ellipsis ', 'g'), '[^a-z0-9/]+', ' ', 'g')) AS key FROM x")
def quote_fold(spark, d):
    return evidence(spark, d).where("quote is not null").select("evidence_id", T.quote_fold("quote").alias("key"))


@query("canonical_tokens", f"WITH {FE}, x AS (SELECT evidence_id, translate(lower(quote), '‘’“”–—', '''''\"\"--') AS t FROM fe WHERE quote IS NOT NULL) SELECT evidence_id, list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<[a-z/][^>]*>', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\.\\.\\.|…', ' ellipsis ', 'g'), '[^a-z0-9/]+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^([0-9]+)(st|nd|rd|th)$', '\\1')) AS tokens FROM x")
def canonical_tokens(spark, d):
    return evidence(spark, d).where("quote is not null").select("evidence_id", T.canonical_tokens("quote").alias("tokens"))


FOLIO = "coalesce(regexp_matches(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), '^\\W*((page|pg|p)\\.?\\s*(no\\.?)?\\s*)?([0-9]{{1,5}}|[ivxlc]{{1,7}})(\\s*(of|/)\\s*[0-9]{{1,5}})?\\W*$'), false)"


@query("folio_lines", f"WITH l AS (SELECT DISTINCT page_id, unnest(string_split(normalized_text, chr(10))) AS line FROM page_text) SELECT page_id, line FROM l WHERE {FOLIO.format('line')}")
def folio_lines(spark, d):
    lines = table(spark, d, "page_text").select("page_id", F.explode(F.split("normalized_text", "\n")).alias("line")).distinct()
    return lines.where(T.is_folio_only("line"))


@query("nonsemantic_filter", f"SELECT DISTINCT record_id FROM chunks WHERE {FOLIO.format('chunk_text')} OR trim(regexp_replace(lower(coalesce(chunk_text, 'x')), '\\s+', ' ', 'g')) IN ('', 'in the supreme court')")
def nonsemantic_filter(spark, d):
    c = table(spark, d, "chunks")
    return c.where(T.is_folio_only("chunk_text", ["", "in the supreme court"])).select("record_id").distinct()


@query("canonical_part_ids", "SELECT DISTINCT document_part, CASE WHEN trim(regexp_replace(lower(coalesce(document_part, '')), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(coalesce(document_part, '')), '[^a-z0-9]+', '_', 'g'), '_') END AS part_id FROM chunks")
def canonical_part_ids(spark, d):
    return table(spark, d, "chunks").select("document_part").distinct().select("document_part", T.part_id("document_part").alias("part_id"))


@query("file_stems", "SELECT DISTINCT filename, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(filename)), '\\.[a-z0-9]{1,5}$', ''), '\\s*\\([0-9]+\\)$|[_ -]+(final|copy|v[0-9]+)$', ''), '[^a-z0-9]+', '_', 'g'), '_') AS stem FROM filing_parts")
def file_stems(spark, d):
    return table(spark, d, "filing_parts").select("filename").distinct().select("filename", T.stem("filename").alias("stem"))


@query("placeholder_blanking", "SELECT DISTINCT lang, CASE WHEN lower(trim(lang)) IN ('', '-', '--', 'n/a', 'na', 'none', 'null', 'nil', 'not available', 'unknown') THEN NULL ELSE trim(lang) END AS known FROM documents")
def placeholder_blanking(spark, d):
    return table(spark, d, "documents").select("lang").distinct().select("lang", T.blank_to_null("lang").alias("known"))


RULES = [("(?i)consent|detriment", "consent"), ("(?i)limitation|delay", "limitation"), ("(?i)evidence|witness", "evidence")]


@query("strategy_case", f"WITH {FE} SELECT evidence_id, CASE WHEN regexp_matches(coalesce(quote, ''), '(?i)consent|detriment') THEN 'consent' WHEN regexp_matches(coalesce(quote, ''), '(?i)limitation|delay') THEN 'limitation' WHEN regexp_matches(coalesce(quote, ''), '(?i)evidence|witness') THEN 'evidence' ELSE 'other' END AS topic FROM fe")
def strategy_case(spark, d):
    return evidence(spark, d).select("evidence_id", T.first_match("quote", RULES, "other").alias("topic"))


@query("date_keys")
def date_keys(spark, d):
    return evidence(spark, d).select("evidence_id", T.date_keys("quote").alias("dates"))


@query("case_numbers", f"WITH {FE} SELECT evidence_id, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(quote, ''), '(?i)No\\.?\\s*([0-9]{{1,6}}\\s*(/|of)\\s*[0-9]{{4}})', 1), lambda x: regexp_replace(lower(x), '\\s*(/|of)\\s*', '/')))) AS cases FROM fe")
def case_numbers(spark, d):
    return evidence(spark, d).select("evidence_id", T.case_numbers("quote").alias("cases"))


@query("annexure_marks", "WITH p AS (SELECT DISTINCT page_id, normalized_text AS t FROM page_text), f AS (SELECT page_id, unnest(regexp_extract_all(upper(coalesce(t, '')), 'ANNEXURES?\\s*[-–:]?\\s*([A-Z]\\s*[-–/]?\\s*[0-9]{1,3})', 1)) AS m FROM p) SELECT DISTINCT page_id, regexp_replace(m, '^([A-Z])\\s*[-–/]?\\s*0*([0-9]+)$', '\\1-\\2') AS mark FROM f")
def annexure_marks(spark, d):
    p = table(spark, d, "page_text").select("page_id", "normalized_text").distinct()
    return p.select("page_id", F.explode(T.annexure_marks("normalized_text")).alias("mark"))


@query("cited_pages", "WITH p AS (SELECT DISTINCT page_id, normalized_text AS t FROM page_text) SELECT page_id, list_transform(regexp_extract_all(lower(coalesce(t, '')), '(pages?|pp?\\.)\\s*(nos?\\.?\\s*)?([0-9]{1,5}(\\s*(-|–|to)\\s*[0-9]{1,5})?)', 3), lambda x: regexp_replace(x, '\\s*(-|–|to)\\s*', '-')) AS cited FROM p")
def cited_pages(spark, d):
    p = table(spark, d, "page_text").select("page_id", "normalized_text").distinct()
    return p.select("page_id", T.cited_pages("normalized_text").alias("cited"))


@query("confidence_percent", f"WITH {PARTIES} SELECT DISTINCT confidence, CASE WHEN p BETWEEN 0 AND 100 THEN CAST(CAST(round_even(p, 0) AS INT) AS VARCHAR) || '%' END AS percent FROM (SELECT confidence, CASE WHEN contains(confidence, '%') THEN x WHEN x <= 1 THEN x * 100 ELSE x END AS p FROM (SELECT confidence, TRY_CAST(regexp_replace(trim(confidence), '\\s*%$', '') AS DOUBLE) AS x FROM pa))")
def confidence_percent(spark, d):
    return parties(spark, d).select("confidence").distinct().select("confidence", T.percent_text("confidence").alias("percent"))


@query("duration_text", "SELECT event_id, CASE WHEN s < 60 THEN CAST(round(s, 1) AS VARCHAR) || 's' WHEN s < 3600 THEN format('{}m {}s', CAST(floor(floor(s) / 60) AS BIGINT), CAST(floor(s) % 60 AS BIGINT)) ELSE format('{}h {}m {}s', CAST(floor(floor(s) / 3600) AS BIGINT), CAST(floor(floor(s) % 3600 / 60) AS BIGINT), CAST(floor(s) % 60 AS BIGINT)) END AS t FROM (SELECT event_id, value * 37 AS s FROM events)")
def duration_text(spark, d):
    return table(spark, d, "events").select("event_id", T.duration_text(F.col("value") * 37).alias("t"))


@query("safe_urls", "SELECT event_id, 'https://files.example/' || event_type || '/' || user_id AS url FROM events")
def safe_urls(spark, d):
    u = F.concat(F.lit("https://user:key@files.example/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"), F.lit("?sig=abc#x"))
    return table(spark, d, "events").select("event_id", T.safe_url(u).alias("url"))


@query("record_ids", "SELECT DISTINCT record_id, CASE WHEN organization_id IS NOT NULL AND workspace_id IS NOT NULL AND file_hash IS NOT NULL AND index_generation IS NOT NULL AND primary_page IS NOT NULL THEN sha256(organization_id || chr(31) || workspace_id || chr(31) || file_hash || chr(31) || index_generation) || ':page:' || primary_page || ':' || coalesce(chunk_index, 0) END AS built FROM chunks")
def record_ids(spark, d):
    base = T.scoped_id("organization_id", "workspace_id", "file_hash", "index_generation")
    built = F.concat(base, F.lit(":page:"), F.col("primary_page").cast("string"), F.lit(":"), F.coalesce("chunk_index", F.lit(0)).cast("string"))
    return table(spark, d, "chunks").select("record_id", built.alias("built")).distinct()


@query("snippets", f"WITH {FE}, a AS (SELECT evidence_id, quote, instr(lower(quote), 'court') AS i FROM fe) SELECT evidence_id, CASE WHEN i > 0 THEN substring(quote, greatest(i - 60, 1), 5 + least(i - 1, 60) + 60) END AS snippet FROM a")
def snippets(spark, d):
    return evidence(spark, d).select("evidence_id", T.snippet("quote", "court").alias("snippet"))


@query(
    "safe_boxes",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 12 - 0.1 AS x, l_tax * 10 AS y, l_quantity / 60 AS w, (l_quantity - 5) / 90 AS h FROM lineitem), c AS (SELECT *, least(greatest(x, 0), 1) AS x0, least(greatest(y, 0), 1) AS y0, least(greatest(x + w, 0), 1) AS x1, least(greatest(y + h, 0), 1) AS y1 FROM b), o AS (SELECT *, w > 0 AND h > 0 AND x1 - x0 >= 0.002 AND y1 - y0 >= 0.002 AS ok FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN round_even(x0, 6) END AS x, CASE WHEN ok THEN round_even(y0, 6) END AS y, CASE WHEN ok THEN round_even(x1 - x0, 6) END AS w, CASE WHEN ok THEN round_even(y1 - y0, 6) END AS h FROM o""",
)
def safe_boxes(spark, d):
    box = T.unit_box(F.col("l_discount") * 12 - 0.1, F.col("l_tax") * 10, F.col("l_quantity") / 60, (F.col("l_quantity") - 5) / 90)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[box[c].alias(c) for c in "xywh"])


@query("label_expansion", "SELECT DISTINCT record_id, list_contains(document_part_ids, 'synopsis') OR list_contains(document_part_ids, 'index') AS front FROM chunks WHERE document_part_ids IS NOT NULL")
def label_expansion(spark, d):
    labels = T.expanded_labels(T.distinct_labels("document_part_ids"), {"synopsis": ["front"], "index": ["front"]})
    return table(spark, d, "chunks").where("document_part_ids is not null").select("record_id", F.array_contains(labels, "front").alias("front")).distinct()


@query("string_lists", "SELECT event_id, ['a', event_type] AS list, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def string_lists(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.text_list(F.concat(F.lit('["a", "'), F.col("event_type"), F.lit('"]'))).alias("list"), T.json_or_empty("props")["k"].alias("k"))


@query("truncated_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS t FROM events")
def truncated_json(spark, d):
    cut = F.concat(F.lit('{"p": '), F.col("props"), F.lit(', "l": [{"t": "'), F.col("event_type"))
    j = T.closed_json(cut)
    return table(spark, d, "events").select("event_id", F.get_json_object(j, "$.p.k").alias("k"), F.get_json_object(j, "$.l[0].t").alias("t"))


ORG = "coalesce(regexp_matches(name, '(?i)\\b(ltd|limited|llp|pvt|private|company|corporation|corpn|bank|society|trust|union|state|government|govt|authority|board|council|commission|department|ministry|university|association|enterprises|industries|municipal)\\b|^m/s'), false)"


@query("party_kinds", f"WITH {PARTIES} SELECT DISTINCT name, kind, CASE WHEN upper(trim(kind)) LIKE 'ORG%' THEN 'ORGANIZATION' WHEN upper(trim(kind)) LIKE 'IND%' THEN 'INDIVIDUAL' WHEN name IS NULL THEN NULL WHEN {ORG} THEN 'ORGANIZATION' ELSE 'INDIVIDUAL' END AS party_kind FROM pa")
def party_kinds(spark, d):
    return parties(spark, d).select("name", "kind").distinct().select("name", "kind", T.party_kind("kind", "name").alias("party_kind"))


@query("plain_names", "WITH a AS (SELECT DISTINCT u.name AS name FROM (SELECT unnest(advocates_on_record) AS u FROM filings)) SELECT name, trim(regexp_replace(regexp_replace(trim(regexp_replace(name, '\\s+', ' ', 'g')), '(?i)^((mr|mrs|ms|dr|shri|smt|sh|kum|sri|prof|miss|m/s)\\.?\\s+)+', ''), '(?i)\\s*[\\(\\[,]?\\s*(petitioner|respondent|appellant|applicant|complainant|advocate|adv|aor)s?(\\s*no\\.?\\s*[0-9]+)?\\s*[\\)\\]]?\\.?$', '')) AS plain FROM a")
def plain_names(spark, d):
    a = table(spark, d, "filings").select(F.explode("advocates_on_record").alias("u")).select("u.name").distinct()
    return a.select("name", T.plain_name("name").alias("plain"))


@query("case_titles", "SELECT DISTINCT filing_id, CASE WHEN m IS NULL THEN NULL WHEN n = 2 THEN m || ' and Anr.' WHEN n > 2 THEN m || ' and Ors.' ELSE m END AS side FROM (SELECT filing_id, len(petitioners) AS n, CASE WHEN lower(trim(cause_title.main_petitioner)) IN ('', '-', '--', 'n/a', 'na', 'none', 'null', 'nil', 'not available', 'unknown') THEN NULL ELSE trim(cause_title.main_petitioner) END AS m FROM filings)")
def case_titles(spark, d):
    return table(spark, d, "filings").select("filing_id", T.side_title(F.col("cause_title.main_petitioner"), F.size("petitioners")).alias("side")).distinct()


@query("name_edit_distance", "SELECT DISTINCT filing_id, levenshtein(lower(cause_title.main_petitioner), lower(petitioners[1].name)) <= 2 AS same, round(1 - levenshtein(cause_title.main_petitioner, petitioners[1].name) / greatest(length(cause_title.main_petitioner), length(petitioners[1].name)), 4) AS alike FROM filings WHERE cause_title.main_petitioner IS NOT NULL AND petitioners[1].name IS NOT NULL")
def name_edit_distance(spark, d):
    f = table(spark, d, "filings").select("filing_id", F.col("cause_title.main_petitioner").alias("a"), F.try_element_at("petitioners", F.lit(1))["name"].alias("b")).where("a is not null and b is not null")
    return f.select("filing_id", T.within_edits(F.lower("a"), F.lower("b"), 2).alias("same"), F.round(T.similarity("a", "b"), 4).alias("alike")).distinct()


@query("byte_slices", "SELECT doc_id, left(text, 3) AS head, md5(substring(text, 4)) AS rest FROM documents WHERE text IS NOT NULL")
def byte_slices(spark, d):
    """Cut behind the third character, by bytes: both parts."""
    t = table(spark, d, "documents").where("text is not null")
    n, size = F.octet_length(F.left("text", F.lit(3))), F.octet_length("text")
    return t.select("doc_id", T.byte_slice("text", F.lit(0), n).alias("head"), F.md5(T.byte_slice("text", n, size).cast("binary")).alias("rest"))
