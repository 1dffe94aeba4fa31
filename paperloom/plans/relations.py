"""Queries of joins, sets, guards, hierarchies and summaries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import relations as R
from ..operators import summaries as S
from ..session import table
from .pages import FP, filing_pages

FE = "fe AS (SELECT DISTINCT evidence_id, filing_id, check_id, status, confidence, page, quote, document_part, slot_id, boxes_status FROM finding_evidence)"


def evidence(spark, d):
    return table(spark, d, "finding_evidence").drop("found_at").distinct()


@query("catalogue_sync_insert", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0")
def catalogue_sync_insert(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.where("s_acctbal > 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("catalogue_missing_guard", "SELECT count(*) AS missing, coalesce(string_agg(filing_id, ', ' ORDER BY filing_id), '') AS keys FROM (SELECT DISTINCT filing_id FROM filing_parts ANTI JOIN finding_evidence USING (filing_id))")
def catalogue_missing_guard(spark, d):
    return R.missing_guard(table(spark, d, "filing_parts"), table(spark, d, "finding_evidence"), "filing_id")


@query("delete_by_join", "SELECT DISTINCT filing_id FROM filings ANTI JOIN (SELECT DISTINCT filing_id FROM finding_evidence WHERE status = 'fail') USING (filing_id)")
def delete_by_join(spark, d):
    return R.without(table(spark, d, "filings").select("filing_id").distinct(), table(spark, d, "finding_evidence").where("status = 'fail'"), ["filing_id"])


@query("update_version", "SELECT c_custkey, CAST(c_nationkey + CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END AS INT) AS c_nationkey FROM customer")
def update_version(spark, d):
    touched = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.versioned(table(spark, d, "customer").select("c_custkey", "c_nationkey"), touched, ["c_custkey"], "c_nationkey")


@query("lookup_preserving", f"WITH {FE}, l AS (SELECT filing_id, max(court) AS court FROM filings GROUP BY 1) SELECT evidence_id, coalesce(court, 'unknown') AS court FROM fe LEFT JOIN l USING (filing_id)")
def lookup_preserving(spark, d):
    return R.with_lookup(evidence(spark, d), table(spark, d, "filings"), "filing_id", "court", "unknown").select("evidence_id", "court")


@query(
    "two_way_difference",
    f"""WITH {FP}, {FE}, a AS (SELECT DISTINCT filing_id, slot_id FROM fp), b AS (SELECT DISTINCT filing_id, slot_id FROM fe WHERE slot_id IS NOT NULL)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def two_way_difference(spark, d):
    return R.two_way_difference(filing_pages(spark, d), evidence(spark, d).where("slot_id is not null"), ["filing_id", "slot_id"])


@query("upsert_latest", "SELECT record_id, content_hash, indexed_at FROM chunks QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY indexed_at DESC NULLS LAST) = 1")
def upsert_latest(spark, d):
    c = table(spark, d, "chunks").select("record_id", "content_hash", "indexed_at")
    cut = F.to_timestamp_ntz(F.lit("2022-06-01 00:00:00"))
    return R.upserted(c.where(F.col("indexed_at") < cut), c.where(~(F.col("indexed_at") < cut) | F.col("indexed_at").isNull()), ["record_id"], "indexed_at")


@query(
    "parent_child_order",
    """WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS VARCHAR) AS i, CASE WHEN n_nationkey % 5 = 0 THEN CASE WHEN n_nationkey = 0 THEN NULL ELSE '99' END ELSE CAST(n_nationkey - 1 AS VARCHAR) END AS p FROM nation),
t AS (SELECT i, i AS root, 0 AS level, [i] AS path FROM n WHERE p IS NULL OR p NOT IN (SELECT i FROM n) UNION ALL SELECT n.i, t.root, t.level + 1, list_append(t.path, n.i) FROM n JOIN t ON n.p = t.i) SELECT i AS n_nationkey, root, level, path FROM t""",
)
def parent_child_order(spark, d):
    n = table(spark, d, "nation")
    parent = F.when(F.col("n_nationkey") % 5 == 0, F.when(F.col("n_nationkey") == 0, F.lit(None)).otherwise(F.lit(99))).otherwise(F.col("n_nationkey") - 1)
    return R.hierarchy(n.select("n_nationkey", parent.alias("parent")), "n_nationkey", "parent")


@query(
    "expected_vs_actual",
    f"""WITH {FE}, e AS (SELECT check_id, max(status) AS v FROM fe WHERE evidence_id % 2 = 0 GROUP BY 1), a AS (SELECT check_id, max(status) AS v FROM fe WHERE evidence_id % 2 = 1 GROUP BY 1)
SELECT check_id, coalesce(e.v, 'missing') AS expected, coalesce(a.v, 'missing') AS actual, coalesce(e.v, 'missing') = coalesce(a.v, 'missing') AS passed FROM e FULL JOIN a USING (check_id)""",
)
def expected_vs_actual(spark, d):
    fe = evidence(spark, d)
    half = lambda n: fe.where(F.col("evidence_id") % 2 == n).groupBy("check_id").agg(F.max("status").alias("v"))
    return R.compared(half(0), half(1), "check_id", "v")


@query("code_sort", "SELECT check_id, row_number() OVER (ORDER BY CAST(regexp_extract(check_id, '^[A-Za-z]+-?0*([0-9]+)', 1) AS BIGINT), check_id) AS place FROM (SELECT DISTINCT check_id FROM finding_evidence WHERE check_id IS NOT NULL)")
def code_sort(spark, d):
    codes = table(spark, d, "finding_evidence").select("check_id").where("check_id is not null").distinct()
    return codes.select("check_id", F.row_number().over(Window.orderBy(*R.code_key("check_id"))).alias("place"))


@query(
    "alias_suppressed_union",
    f"""WITH {FE}, u AS (SELECT check_id, min(CASE WHEN status = 'fail' THEN 0 WHEN status = 'needs_review' THEN 1 END) AS source_ord FROM fe WHERE status IN ('fail', 'needs_review') AND check_id IS NOT NULL GROUP BY 1)
SELECT * FROM u WHERE NOT (check_id = 'D-002' AND 'D-001' IN (SELECT check_id FROM u)) AND NOT (check_id = 'D-004' AND 'D-003' IN (SELECT check_id FROM u))""",
)
def alias_suppressed_union(spark, d):
    fe = evidence(spark, d).where("check_id is not null")
    parts = [fe.where(F.col("status") == s).select("check_id").distinct() for s in ("fail", "needs_review")]
    pairs = spark.createDataFrame([("D-002", "D-001"), ("D-004", "D-003")], "alias string, preferred string")
    return R.suppressed_aliases(R.first_wins_union(parts, "check_id"), pairs, "check_id")


@query("schema_union", "SELECT kind, id, name, CAST(NULL AS DOUBLE) AS balance, CAST(region AS INT) AS region FROM (SELECT 'nation' AS kind, n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation) UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def schema_union(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return R.schema_union({"nation": n, "supplier": s}, "kind")


@query("fetch_by_ids", "SELECT DISTINCT record_id, content_hash FROM chunks WHERE record_id IN (SELECT record_id FROM chunks WHERE chunk_index = 2)")
def fetch_by_ids(spark, d):
    c = table(spark, d, "chunks").select("record_id", "content_hash", "chunk_index")
    return R.fetched(c.select("record_id", "content_hash"), c.where("chunk_index = 2"), "record_id")


@query("flag_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def flag_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", " Active ").otherwise("no").alias("is_active"))
    return R.flag_filter(o, ["is_active", "active", "status"]).select("o_orderkey")


@query(
    "absence_owner",
    f"""WITH {FE}, w AS (SELECT replace(lower(document_part), ' ', '_') AS part, check_id, count(*) AS n FROM fe WHERE document_part IS NOT NULL AND check_id IS NOT NULL GROUP BY 1, 2)
SELECT part, check_id FROM w WHERE part NOT IN (SELECT document_part_id FROM chunks WHERE document_part_id IS NOT NULL AND vector_schema_version IS NULL) QUALIFY row_number() OVER (PARTITION BY part ORDER BY n, check_id) = 1""",
)
def absence_owner(spark, d):
    fe = evidence(spark, d).where("document_part is not null and check_id is not null")
    wanted = fe.groupBy(F.replace(F.lower("document_part"), F.lit(" "), F.lit("_")).alias("part"), "check_id").agg(F.count("*").alias("n"))
    present = table(spark, d, "chunks").where("document_part_id is not null and vector_schema_version is null").select(F.col("document_part_id").alias("part"))
    return R.owner_of_missing(wanted, present, "part", ["n", "check_id"], "check_id")


@query("replay_dedupe", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def replay_dedupe(spark, d):
    e = table(spark, d, "events").withColumn("job", F.concat_ws("-", "user_id", "event_type"))
    return R.exactly_once(e, "job", ["ts", "event_id"]).select("event_id")


STATUS = ["pass", "fail", "needs_review", "not_applicable"]


@query("status_summary", f"WITH {FE} SELECT filing_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in STATUS) + ", count(*) AS total, coalesce(round_even(sum(CAST(round(confidence * 1000000) AS BIGINT)) / (count(confidence) * 1000), 0) / 1000, 0.0) AS mean_confidence FROM fe GROUP BY 1")
def status_summary(spark, d):
    return S.status_summary(evidence(spark, d), ["filing_id"], "status", STATUS, "confidence")


@query(
    "usage_summary_share",
    """WITH p AS (SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS tokens, round_even(sum(CASE WHEN event_type <> 'error' THEN value END), 6) AS cost FROM events GROUP BY 1)
SELECT event_type, tokens, cost, round_even(coalesce(cost, 0) / sum(cost) OVER (), 4) AS share, row_number() OVER (ORDER BY coalesce(cost, -1) DESC, tokens DESC, event_type) AS rank FROM p""",
)
def usage_summary_share(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.when(F.col("event_type") != "error", F.col("value")).alias("cost"))
    return S.usage_shares(e, "event_type", "tokens", "cost")


@query(
    "usage_dedupe_billing",
    """WITH j AS (SELECT event_type, CASE WHEN user_id % 10 <> 0 THEN user_id END AS job, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS c FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type, job ORDER BY c IS NULL, event_id) AS n FROM j)
SELECT event_type, count(*) AS jobs, count(c) AS billed, count(*) FILTER (c IS NULL) AS pending, round_even(sum(c), 4) AS credits, round_even(sum(c) * 0.002, 6) AS price FROM o WHERE job IS NULL OR n = 1 GROUP BY 1""",
)
def usage_dedupe_billing(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("job"), "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("credits"))
    return S.billing(e, "event_type", "job", "credits", "event_id", 0.002)


@query("even_share_remainder", "SELECT o_custkey, o_orderkey, CAST(floor(t / n) + CASE WHEN r <= t % n THEN 1 ELSE 0 END AS BIGINT) AS share FROM (SELECT *, max(CAST(o_totalprice AS BIGINT)) OVER w AS t, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders) WINDOW w AS (PARTITION BY o_custkey))")
def even_share_remainder(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("t"))
    return S.even_shares(o, "o_custkey", "o_orderkey", "t")


@query(
    "decisive_status",
    f"""WITH {FE} SELECT filing_id, check_id, CASE WHEN bool_or(coalesce(status = 'fail', false)) THEN 'fail' WHEN bool_and(coalesce(status = 'pass', false)) THEN 'pass' WHEN bool_and(coalesce(status = 'not_applicable', false)) THEN 'not_applicable' ELSE 'needs_review' END AS decision,
arg_max(status, coalesce(confidence, -1) * 1e6 + ascii(status) / 1000.0) AS most_confident FROM fe GROUP BY 1, 2""",
)
def decisive_status(spark, d):
    return S.decisive(evidence(spark, d), ["filing_id", "check_id"], "status", "confidence", "fail", "pass", "not_applicable", "needs_review")


@query("distinct_terms", f"WITH {FE}, f AS (SELECT filing_id, document_part AS v, min(evidence_id) AS o FROM fe WHERE document_part IS NOT NULL GROUP BY 1, 2) SELECT filing_id, list(v ORDER BY o, v) AS \"values\" FROM f GROUP BY 1")
def distinct_terms(spark, d):
    return S.distinct_in_order(evidence(spark, d), ["filing_id"], "document_part", "evidence_id")


@query("box_union", "SELECT l_orderkey, min(l_discount) AS x, min(l_tax) AS y, round_even(max(l_discount + l_quantity / 100) - min(l_discount), 6) AS w, round_even(max(l_tax + l_linenumber / 10) - min(l_tax), 6) AS h FROM lineitem GROUP BY 1")
def box_union(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_tax", (F.col("l_quantity") / 100).alias("bw"), (F.col("l_linenumber") / 10).alias("bh"))
    return S.box_union(li, ["l_orderkey"], "l_discount", "l_tax", "bw", "bh")


@query("median_gap", f"WITH {FP}, g AS (SELECT filing_id, page - lag(page) OVER (PARTITION BY filing_id ORDER BY page) AS g FROM (SELECT DISTINCT filing_id, page FROM fp)) SELECT filing_id, CAST(median(g) AS DOUBLE) AS median_gap FROM g WHERE g > 0 GROUP BY 1")
def median_gap(spark, d):
    return S.median_gap(filing_pages(spark, d).select("filing_id", "page").distinct(), ["filing_id"], "page")


@query("dominant_status", f"WITH {FE} SELECT check_id, boxes_status, count(*) AS n FROM fe WHERE boxes_status IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY count(*) DESC, boxes_status) = 1")
def dominant_status(spark, d):
    return S.dominant(evidence(spark, d), ["check_id"], "boxes_status")


@query("list_hashes", "SELECT filing_id, sha256(to_json(list(DISTINCT file_hash ORDER BY file_hash))) AS list_hash FROM filing_parts WHERE file_hash IS NOT NULL GROUP BY 1")
def list_hashes(spark, d):
    return S.list_hash(table(spark, d, "filing_parts").where("file_hash is not null"), ["filing_id"], F.col("file_hash"))


@query("content_duplicates", "SELECT content_hash, count(DISTINCT record_id) AS n FROM chunks WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT record_id) > 1")
def content_duplicates(spark, d):
    return S.duplicates(table(spark, d, "chunks").where("content_hash is not null"), ["content_hash"], "record_id")


@query("monotone_progress", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def monotone_progress(spark, d):
    return S.running_max(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "progress")


@query("flatten_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
