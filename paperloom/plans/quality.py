"""Queries of chunking, validation, evaluation, entity collapse and alignment."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import alignment as A
from ..operators import chunking as C
from ..operators import quality as Q
from ..operators import summaries as S
from ..session import table
from .pages import PT, scanned
from .relations import FE, evidence


def docs(spark, d):
    return table(spark, d, "documents")


@query("text_windows_fixed", "WITH x AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 500) / 450), 0) AS INT) + 1)) AS k FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(k AS INT) AS \"window\", md5(substring(text, k * 450 + 1, 500)) AS h FROM x")
def text_windows_fixed(spark, d):
    return C.fixed_windows(docs(spark, d), ["doc_id"], "text", 500, 450).select("doc_id", "window", F.md5(F.col("piece").cast("binary")).alias("h"))


@query("text_windows_boundary")
def text_windows_boundary(spark, d):
    return C.text_windows(docs(spark, d), ["doc_id"], "text")


@query("semantic_chunks")
def semantic_chunks(spark, d):
    return C.page_chunks(scanned(spark, d), ["page_id"], "t")


@query("page_records")
def page_records(spark, d):
    return C.page_records(scanned(spark, d), ["filing_id"], "page", "t", size=800)


@query("page_segments", f"WITH {PT} SELECT page_id, trim(t, chr(10) || ' ') AS again FROM pt WHERE t IS NOT NULL AND length(trim(t)) > 0 AND NOT contains(t, '[page')")
def page_segments(spark, d):
    p = scanned(spark, d).where("t is not null and length(trim(t)) > 0 and not contains(t, '[page')")
    whole = C.with_segments(F.lit("before"), F.btrim("t", F.lit("\n ")), F.lit("after"), F.col("page"))
    return p.select("page_id", F.try_element_at(C.segments(whole), F.col("page")).alias("again"))


@query("filing_descriptions", "SELECT DISTINCT filing_id, concat_ws(chr(10), CASE WHEN trim(court) <> '' THEN 'Court: ' || court END, CASE WHEN trim(petition_type) <> '' THEN 'Type: ' || petition_type END, CASE WHEN trim(cause_title.title) <> '' THEN 'Title: ' || cause_title.title END) AS description FROM filings")
def filing_descriptions(spark, d):
    fields = {"Court": F.col("court"), "Type": F.col("petition_type"), "Title": F.col("cause_title.title")}
    return C.described(table(spark, d, "filings"), ["filing_id"], fields).distinct()


@query(
    "fetch_page_windows",
    """WITH c AS (SELECT DISTINCT file_hash, primary_page, chunk_index, chunk_text FROM chunks WHERE file_hash IS NOT NULL AND primary_page IS NOT NULL AND chunk_index IS NOT NULL AND chunk_kind = 'page'),
u AS (SELECT file_hash, primary_page, chunk_index, any_value(chunk_text) AS t FROM c GROUP BY 1, 2, 3 HAVING count(*) = 1), n AS (SELECT *, row_number() OVER w AS n, coalesce(sum(length(coalesce(t, '')) + 2) OVER (PARTITION BY file_hash, primary_page ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 2 AS k FROM u WINDOW w AS (PARTITION BY file_hash, primary_page ORDER BY chunk_index))
SELECT * FROM (SELECT file_hash, primary_page, string_agg(t, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM n WHERE n = chunk_index + 1 AND n <= 4 AND (chunk_index = 0 OR k < 500) GROUP BY 1, 2) WHERE trim(text) <> ''""",
)
def fetch_page_windows(spark, d):
    c = table(spark, d, "chunks").where("file_hash is not null and primary_page is not null and chunk_index is not null and chunk_kind = 'page'").select("file_hash", "primary_page", "chunk_index", "chunk_text").distinct()
    one = c.groupBy("file_hash", "primary_page", "chunk_index").agg(F.any_value("chunk_text").alias("chunk_text"), F.count("*").alias("n")).where("n = 1").drop("n")
    return C.fetched_windows(one, "file_hash", "primary_page", "chunk_index", "chunk_text")


CH = "ch AS (SELECT DISTINCT record_id, workspace_id, index_generation, chunk_text, chunk_kind, vector_schema_version, document_part_id, primary_page, content_hash FROM chunks)"
RULES_SQL = {
    "missing_text": ("error", "chunk_kind = 'page' AND (chunk_text IS NULL OR trim(chunk_text) = '')"),
    "content_hash_mismatch": ("error", "chunk_text IS NOT NULL AND content_hash <> sha256(chunk_text)"),
    "invalid_chunk_kind": ("error", "chunk_kind IS NULL OR chunk_kind NOT IN ('page', 'page_manifest', 'summary')"),
    "missing_page_field": ("error", "chunk_kind = 'page' AND primary_page IS NULL"),
    "schema_version_mismatch": ("error", "vector_schema_version IS NULL OR vector_schema_version <> 4"),
    "missing_canonical_part": ("error", "chunk_kind = 'page' AND document_part_id IS NULL"),
    "low_information_chunk": ("warning", "chunk_text IS NOT NULL AND length(chunk_text) < 40"),
}


def _rules():
    text, kind = F.col("chunk_text"), F.col("chunk_kind")
    return [
        ("missing_text", "error", (kind == "page") & (text.isNull() | (F.trim(text) == ""))),
        ("content_hash_mismatch", "error", text.isNotNull() & (F.col("content_hash") != F.sha2(text, 256))),
        ("invalid_chunk_kind", "error", kind.isNull() | ~kind.isin("page", "page_manifest", "summary")),
        ("missing_page_field", "error", (kind == "page") & F.col("primary_page").isNull()),
        ("schema_version_mismatch", "error", F.col("vector_schema_version").isNull() | (F.col("vector_schema_version") != 4)),
        ("missing_canonical_part", "error", (kind == "page") & F.col("document_part_id").isNull()),
        ("low_information_chunk", "warning", text.isNotNull() & (F.length(text) < 40)),
    ]


def records(spark, d):
    return table(spark, d, "chunks").select("record_id", "workspace_id", "index_generation", "chunk_text", "chunk_kind", "vector_schema_version", "document_part_id", "primary_page", "content_hash").distinct()


ISSUES = " UNION ALL ".join(f"SELECT record_id, '{c}' AS code, '{s}' AS severity FROM ch WHERE {x}" for c, (s, x) in RULES_SQL.items())


@query("validator_issues", f"WITH {CH} {ISSUES}")
def validator_issues(spark, d):
    return Q.issues(records(spark, d), "record_id", _rules())


@query("validator_summary", f"WITH {CH}, i AS ({ISSUES}), p AS (SELECT record_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM i GROUP BY 1) SELECT workspace_id, index_generation, count(*) AS records, coalesce(sum(e), 0) AS errors, coalesce(sum(w), 0) AS warnings, coalesce(sum(e), 0) = 0 AS passed FROM (SELECT DISTINCT workspace_id, index_generation, record_id FROM ch) LEFT JOIN p USING (record_id) GROUP BY 1, 2")
def validator_summary(spark, d):
    rows = records(spark, d)
    return Q.validation_summary(Q.issues(rows, "record_id", _rules()), rows, ["workspace_id", "index_generation"], "record_id")


@query("record_counters", "SELECT index_generation, chunk_kind, count(DISTINCT record_id) AS records FROM chunks GROUP BY 1, 2")
def record_counters(spark, d):
    return table(spark, d, "chunks").groupBy("index_generation", "chunk_kind").agg(F.count_distinct("record_id").alias("records"))


AN = "a AS (SELECT DISTINCT case_id, document_id, start_page AS s, end_page AS e, page_count AS n FROM annotations), b AS (SELECT *, s IS NULL OR e IS NULL OR s < 1 OR s > e OR e > n AS bad FROM a), g AS (SELECT * FROM b WHERE NOT bad), o AS (SELECT *, max(e) OVER (PARTITION BY case_id ORDER BY s, e, document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM g)"


@query(
    "annotation_faults",
    f"""WITH {AN} SELECT DISTINCT * FROM (SELECT case_id, document_id, 'bad_range' AS fault FROM b WHERE bad UNION ALL SELECT case_id, document_id, 'repeated_id' FROM a GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT case_id, document_id, 'overlap' FROM o WHERE s <= m UNION ALL SELECT case_id, document_id, 'gap_before' FROM o WHERE s > coalesce(m, 0) + 1 UNION ALL SELECT case_id, NULL, 'uncovered_end' FROM g GROUP BY 1 HAVING max(e) < max(n))""",
)
def annotation_faults(spark, d):
    return Q.annotation_faults(table(spark, d, "annotations"), "case_id", "document_id", "start_page", "end_page", "page_count")


def _truth(spark, d):
    a = table(spark, d, "annotations").where("start_page >= 1 and start_page <= end_page")
    return a.groupBy("case_id", F.col("document_id").alias("id")).agg(F.min("category").alias("type"), F.min("start_page").alias("start"), F.min("end_page").alias("end")).where("start <= end")


def _guess(spark, d):
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    t = _truth(spark, d).select("case_id", F.concat(F.lit("seg_"), "id").alias("id"), F.when(n % 4 == 0, F.lit("Other")).otherwise(F.col("type")).alias("type"), F.when(n % 3 == 0, F.col("start") + 1).otherwise(F.col("start")).alias("start"), "end")
    return t.where("start <= end")


TRUTH = """t AS (SELECT * FROM (SELECT case_id, document_id AS id, min(category) AS type, min(start_page) AS s, min(end_page) AS e FROM annotations WHERE start_page >= 1 AND start_page <= end_page GROUP BY 1, 2) WHERE s <= e),
q AS (SELECT case_id, 'seg_' || id AS id, CASE WHEN n % 4 = 0 THEN 'Other' ELSE type END AS type, CASE WHEN n % 3 = 0 THEN s + 1 ELSE s END AS s, e FROM (SELECT *, CAST(regexp_extract(id, '([0-9]+)$', 1) AS INT) AS n FROM t)), p AS (SELECT * FROM q WHERE s <= e)"""


@query("span_matching")
def span_matching(spark, d):
    return Q.matched_spans(_truth(spark, d), _guess(spark, d), "case_id")


@query(
    "span_matching_checks",
    f"""WITH {TRUTH}, l AS (SELECT t.case_id, t.id AS a, p.id AS b, least(t.e, p.e) - greatest(t.s, p.s) + 1 AS w FROM t JOIN p ON t.case_id = p.case_id AND t.s <= p.e AND p.s <= t.e),
n AS (SELECT *, count(*) OVER (PARTITION BY case_id, a) AS na, count(*) OVER (PARTITION BY case_id, b) AS nb FROM l)
SELECT case_id, count(DISTINCT a) > 0 AS one_to_one, count(*) FILTER (na = 1 AND nb = 1) AS sole_links FROM n GROUP BY 1""",
)
def span_matching_checks(spark, d):
    """The matching is one-to-one, and keeps every link whose two spans overlap nothing else."""
    truth, guess = _truth(spark, d), _guess(spark, d)
    chosen = Q.matched_spans(truth, guess, "case_id").select("case_id", F.col("true_id").alias("_a"), F.col("predicted_id").alias("_b"))
    per = chosen.groupBy("case_id").agg((F.count_distinct("_a") == F.count("*")).alias("_l"), (F.count_distinct("_b") == F.count("*")).alias("_r"))
    page = lambda df, c: df.select("case_id", F.col("id").alias(c), F.explode(F.sequence("start", "end")).alias("_p"))
    links = page(truth, "_a").join(page(guess, "_b"), ["case_id", "_p"]).select("case_id", "_a", "_b").distinct()
    one = lambda c: links.groupBy("case_id", c).agg(F.count("*").alias(f"_n{c}")).where(f"_n{c} = 1").select("case_id", c)
    sole = chosen.join(one("_a"), ["case_id", "_a"]).join(one("_b"), ["case_id", "_b"]).groupBy("case_id").agg(F.count("*").alias("_s"))
    return per.join(sole, "case_id", "left").select("case_id", (F.col("_l") & F.col("_r")).alias("one_to_one"), F.coalesce("_s", F.lit(0)).alias("sole_links"))


@query(
    "boundary_metrics",
    f"""WITH {TRUTH}, x AS (SELECT DISTINCT case_id, s FROM t), y AS (SELECT DISTINCT case_id, s FROM p), j AS (SELECT coalesce(x.case_id, y.case_id) AS case_id, x.s AS a, y.s AS b FROM x FULL JOIN y ON x.case_id = y.case_id AND x.s = y.s),
c AS (SELECT coalesce(q.quality, 'none') AS quality, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS hits, count(b) AS predicted, count(a) AS expected FROM j JOIN (SELECT case_id, max(quality) AS quality FROM annotations GROUP BY 1) q USING (case_id) GROUP BY 1), m AS (SELECT *, hits / predicted AS pr, hits / expected AS re FROM c)
SELECT quality, hits, predicted, expected, round_even(pr, 6) AS "precision", round_even(re, 6) AS recall, round_even(2 * pr * re / (pr + re), 6) AS f1 FROM m""",
)
def boundary_metrics(spark, d):
    edge = lambda df: df.select("case_id", F.col("start").alias("page"))
    counts = Q.boundary_counts(edge(_truth(spark, d)), edge(_guess(spark, d)), "case_id")
    quality = table(spark, d, "annotations").groupBy("case_id").agg(F.coalesce(F.max("quality"), F.lit("none")).alias("quality"))
    return S.micro_metrics(counts.join(quality, "case_id"), ["quality"], "hits", "predicted", "expected")


@query("metrics_by_type", f"WITH {TRUTH}, m AS (SELECT t.type, count(*) AS expected, count(p.id) AS predicted, count(*) FILTER (p.s = t.s AND p.e = t.e AND p.type = t.type) AS hits FROM t LEFT JOIN p ON p.case_id = t.case_id AND p.id = 'seg_' || t.id GROUP BY 1) SELECT type, hits, predicted, expected, round_even(hits / predicted, 6) AS \"precision\", round_even(hits / expected, 6) AS recall, round_even(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / predicted) * (hits / expected) / (hits / predicted + hits / expected) END, 6) AS f1 FROM m")
def metrics_by_type(spark, d):
    t = _truth(spark, d)
    p = _guess(spark, d).select("case_id", F.substring("id", 5, 100).alias("id"), F.col("type").alias("pt"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    j = t.join(p, ["case_id", "id"], "left").select("type", F.lit(1).alias("e"), F.col("ps").isNotNull().cast("int").alias("p"), F.coalesce(((F.col("ps") == F.col("start")) & (F.col("pe") == F.col("end")) & (F.col("pt") == F.col("type"))).cast("int"), F.lit(0)).alias("h"))
    return S.micro_metrics(j, ["type"], "h", "p", "e")


@query(
    "page_ownership",
    f"""WITH {TRUTH}, x AS (SELECT case_id, page, min(id) AS owner FROM (SELECT case_id, id, unnest(range(s, e + 1)) AS page FROM t) GROUP BY 1, 2), y AS (SELECT case_id, page, count(DISTINCT id) AS n, min(id) AS o FROM (SELECT case_id, substring(id, 5) AS id, unnest(range(s, e + 1)) AS page FROM p) GROUP BY 1, 2)
SELECT case_id, count(*) AS pages, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS several, count(*) FILTER (n = 1 AND o = owner) AS "right", round_even(count(*) FILTER (n = 1 AND o = owner) / count(*), 6) AS accuracy FROM x LEFT JOIN y USING (case_id, page) GROUP BY 1""",
)
def page_ownership(spark, d):
    pages = lambda df, c: df.select("case_id", c.alias("owner"), F.explode(F.sequence("start", "end")).alias("page"))
    return Q.page_ownership(pages(_truth(spark, d), F.col("id")), pages(_guess(spark, d), F.substring("id", 5, 100)), "case_id")


@query("party_collapse")
def party_collapse(spark, d):
    p = table(spark, d, "filings").select("filing_id", F.posexplode("petitioners").alias("pos", "u")).select("filing_id", "pos", "u.name", "u.guardian", "u.address", "u.city").distinct()
    rich = sum((F.col(c).isNotNull().cast("int") for c in ("name", "guardian", "address", "city")), F.lit(0))
    return Q.collapsed_parties(p, "filing_id", "pos", "name", "guardian", rich)


@query("vision_batches")
def vision_batches(spark, d):
    e = evidence(spark, d).where("page is not null").select("filing_id", "evidence_id", F.array(F.col("page") % 9, (F.col("page") + 1) % 9).alias("pages"))
    return Q.packed_batches(e, "filing_id", "evidence_id", "pages")


@query("quote_shingle_match")
def quote_shingle_match(spark, d):
    return A.aligned_quotes(evidence(spark, d), scanned(spark, d), "filing_id", "evidence_id", "quote", "page", "t", "page")


FOLDQ = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(
    "quote_containment",
    f"""WITH {FE}, {PT}, u AS (SELECT evidence_id, filing_id, 0 AS part, quote AS q FROM fe UNION ALL SELECT evidence_id, filing_id, unnest(range(1, len(qs) + 1)), unnest(qs) FROM (SELECT evidence_id, filing_id, string_split(quote, '. ') AS qs FROM fe WHERE quote IS NOT NULL)),
n AS (SELECT evidence_id, part, filing_id, {FOLDQ.format("q")} AS q FROM u WHERE trim(coalesce(q, '')) <> '') SELECT evidence_id, CAST(part AS INT) AS part, page_id FROM n JOIN (SELECT page_id, filing_id, {FOLDQ.format("t")} AS t FROM pt) USING (filing_id) WHERE contains(t, q)""",
)
def quote_containment(spark, d):
    """Whole quotes (part 0) and each of their sentences in the pages of their filing."""
    e = evidence(spark, d).select("evidence_id", "filing_id", F.posexplode(F.concat(F.array("quote"), F.coalesce(F.split("quote", r"\. "), F.array().cast("array<string>")))).alias("part", "q"))
    found = A.contained(e.withColumn("_id", F.struct("evidence_id", "part")), scanned(spark, d), "filing_id", "q", "t", "_id", "page_id")
    return found.select("_id.evidence_id", "_id.part", "page_id")


@query(
    "evidence_binding",
    f"""WITH {FE}, p AS (SELECT DISTINCT filing_id, file_hash FROM filing_parts WHERE file_hash IS NOT NULL), e AS (SELECT DISTINCT evidence_id, file_hash, document_part AS c, page, quote FROM fe JOIN p USING (filing_id)), k AS (SELECT DISTINCT record_id, file_hash, document_part AS c2, page_start AS a, page_end AS z, chunk_text FROM chunks WHERE file_hash IS NOT NULL),
h AS (SELECT evidence_id, record_id, CASE WHEN c = c2 THEN 0 WHEN page BETWEEN a AND z THEN 1 ELSE 2 END AS priority FROM e JOIN k USING (file_hash) WHERE trim(coalesce(quote, '')) <> '' AND contains({FOLDQ.format("chunk_text")}, {FOLDQ.format("quote")})),
l AS (SELECT file_hash, c2 AS c, min(record_id) AS record_id FROM k GROUP BY 1, 2), u AS (SELECT * FROM h UNION ALL SELECT evidence_id, record_id, 3 FROM e JOIN l USING (file_hash, c))
SELECT evidence_id, record_id, priority FROM u QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY priority, record_id) = 1""",
)
def evidence_binding(spark, d):
    """Whole quotes in whole chunks of the filing's files, the cited part standing for the cited id."""
    files = table(spark, d, "filing_parts").select("filing_id", "file_hash").where("file_hash is not null").distinct()
    c = table(spark, d, "chunks")
    return A.bound_chunks(evidence(spark, d).join(files, "filing_id"), c, "file_hash", "document_part", "quote", "page", "evidence_id", "record_id", "chunk_text", "page_start", "page_end")


def _place():
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


def _words(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", _place().alias("n"), (F.col("l_quantity") / 60).alias("x"), (F.col("l_linenumber") / 9).alias("y"), (F.col("l_tax") + 0.01).alias("w"), (F.col("l_discount") / 2 + 0.01).alias("h"))


@query("visual_lines")
def visual_lines(spark, d):
    return A.visual_lines(_words(spark, d), "l_orderkey", "n")


@query("jump_filter", "WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 / 4.0 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem), c AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY n)) > 0.3 THEN 1 ELSE 0 END AS c FROM w), r AS (SELECT *, sum(c) OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM c), s AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, run) AS k FROM r), l AS (SELECT *, max(k) OVER (PARTITION BY l_orderkey) AS m FROM s) SELECT l_orderkey, n, y FROM l WHERE k >= 2 OR k = m")
def jump_filter(spark, d):
    words = table(spark, d, "lineitem").select("l_orderkey", _place().alias("n"), (F.col("l_linenumber") % 4 / 4.0).alias("y"))
    return A.without_jumps(words, "l_orderkey", "n", 0.3, 2)


@query("page_margins", "WITH w AS (SELECT l_orderkey, l_quantity / 60 AS x, l_linenumber / 9 AS y, l_tax + 0.01 AS w, l_discount / 2 + 0.01 AS h FROM lineitem), m AS (SELECT l_orderkey, min(x) * 595.0 AS l, (1 - max(x + w)) * 595.0 AS r, min(y) * 842.0 AS t, (1 - max(y + h)) * 842.0 AS b FROM w GROUP BY 1) SELECT l_orderkey, round_even(l, 2) AS \"left\", round_even(r, 2) AS \"right\", round_even(t, 2) AS top, round_even(b, 2) AS bottom, least(l, r) + 3.0 >= 113.4 AND least(t, b) + 3.0 >= 56.7 AS wide_enough FROM m")
def page_margins(spark, d):
    return A.margins(_words(spark, d), ["l_orderkey"])
