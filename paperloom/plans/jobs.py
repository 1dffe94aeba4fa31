"""Queries of sources, sinks and job streams."""

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..session import table, work_dir
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import jobs as J
from .pages import PT, scanned


def events(spark, d):
    return table(spark, d, "events")


def _place(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    out = J.first_messages(J.event_stream(spark, d), ["user_id", "event_type"], "ts", "3650 days")
    return J.run_once(out).select("user_id", "event_type")


@query("stream_progress", "SELECT user_id, max(value) AS progress, count(*) AS messages FROM events GROUP BY 1")
def stream_progress(spark, d):
    return J.run_once(J.latest_progress(J.event_stream(spark, d), "user_id", "value"), "complete")


@query("stream_state_progress", "SELECT user_id, max(value) AS progress, count(*) AS messages FROM events GROUP BY 1")
def stream_state_progress(spark, d):
    out = J.run_once(J.stateful_progress(J.event_stream(spark, d).select("user_id", "value"), "user_id", "value"), "update")
    return out.groupBy("user_id").agg(F.max_by("progress", "batch").alias("progress"), F.max_by("messages", "batch").alias("messages"))


@query("tumbling_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    out = J.run_once(J.tumbling_counts(J.event_stream(spark, d), "ts", "1 hour", ["event_type"]), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("event_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM b GROUP BY user_id, k")
def event_sessions(spark, d):
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return J.sessions(e, "ts", "6 hours", ["user_id"]).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("paced_requests", "WITH r AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_id, round_even(max(t - n * 7200.0) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 7200.0, 3) AS slot FROM r")
def paced_requests(spark, d):
    return J.paced(events(spark, d), "user_id", "ts", "event_id", 7200.0)


ORDERED = "r AS (SELECT user_id, event_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query("token_bucket_waits", f"WITH {ORDERED}, v AS (SELECT *, max(t - n * 300.0) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) + (n + 1) * 300.0 AS full_at FROM r) SELECT user_id, event_id, round_even(greatest(full_at - 3 * 300.0 - t, 0), 3) AS wait FROM v")
def token_bucket_waits(spark, d):
    return J.token_bucket(events(spark, d), "user_id", "ts", "event_id", 0.2, 3)


@query(
    "job_leases",
    f"""WITH RECURSIVE {ORDERED}, l AS (SELECT user_id, event_id, n, event_type AS holder, t + 86400 AS until, true AS granted FROM r WHERE n = 1
UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN r.t >= l.until OR r.event_type = l.holder THEN r.event_type ELSE l.holder END, CASE WHEN r.t >= l.until OR r.event_type = l.holder THEN r.t + 86400 ELSE l.until END, r.t >= l.until OR r.event_type = l.holder FROM l JOIN r ON r.user_id = l.user_id AND r.n = l.n + 1)
SELECT user_id, event_id, granted FROM l""",
)
def job_leases(spark, d):
    """A job (a user here) is leased by one owner (an event's type) at a time."""
    return J.leases(events(spark, d), "user_id", "event_type", "ts", 86400, "event_id")


@query("job_deadlines", "SELECT user_id, min(ts) AS first, max(ts) AS last, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(min(ts)) > 5400 AS expired FROM events GROUP BY 1")
def job_deadlines(spark, d):
    return J.deadlines(events(spark, d), "user_id", "ts", "2024-02-01 00:00:00")


@query(
    "failure_cooldowns",
    f"""WITH {ORDERED}, f AS (SELECT *, coalesce(CAST(t - lag(t) OVER w > 86400 AS INT), 1) AS fresh FROM r WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY n)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY n) AS run FROM f)
SELECT user_id, event_id, least(300.0, CASE WHEN event_id % 9 = 0 THEN 45.0 ELSE 30 * pow(2, row_number() OVER (PARTITION BY user_id, run ORDER BY n) - 1) END) AS cooldown FROM g UNION ALL SELECT user_id, event_id, 0.0 FROM r WHERE event_type IS DISTINCT FROM 'error'""",
)
def failure_cooldowns(spark, d):
    e = events(spark, d).withColumn("failed", F.col("event_type") == "error").withColumn("own", F.when(F.col("event_id") % 9 == 0, 45.0))
    return J.cooldowns(e, "user_id", "ts", "failed", "event_id", reset=86400, retry_after="own")


@query(
    "microbatch_fold",
    """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch(ts) AS t, length(props) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), b AS (SELECT user_id, event_id, n, 0 AS batch, 1 AS size, c AS used, t AS start FROM r WHERE n = 1
UNION ALL SELECT user_id, event_id, n, CASE WHEN o THEN batch + 1 ELSE batch END, CASE WHEN o THEN 1 ELSE size + 1 END, CASE WHEN o THEN c ELSE used + c END, CASE WHEN o THEN t ELSE start END FROM (SELECT r.*, b.batch, b.size, b.used, b.start, b.size >= 3 OR r.t - b.start > 86400 OR b.used + r.c > 25 AS o FROM b JOIN r ON r.user_id = b.user_id AND r.n = b.n + 1))
SELECT user_id, event_id, batch FROM b""",
)
def microbatch_fold(spark, d):
    return J.micro_batches(events(spark, d).withColumn("c", F.length("props")), "user_id", "ts", "event_id", "c", window=86400, budget=25)


@query(
    "queue_state",
    """WITH m AS (SELECT user_id % 997 AS message_id, min(epoch(ts)) AS sent FROM events WHERE event_type = 'view' GROUP BY 1), a AS (SELECT user_id % 997 AS message_id, epoch(ts) AS tt, CASE WHEN event_type = 'error' AND event_id % 40 = 0 THEN 'delete' WHEN event_type = 'click' THEN 'receive' WHEN event_type = 'purchase' THEN 'extend' ELSE 'other' END AS action, CASE WHEN event_id % 2 = 0 THEN 864000.0 ELSE 30.0 END AS secs FROM events),
s AS (SELECT message_id, bool_or(action = 'delete') AS gone, max(row(tt, tt + secs)) FILTER (action IN ('receive', 'extend')) AS u FROM a JOIN m USING (message_id) WHERE tt >= sent GROUP BY 1)
SELECT message_id, sent AS sent_at, u[2] AS hidden_until, coalesce(u[2] <= epoch(TIMESTAMP '2024-01-20 00:00:00'), true) AS visible FROM m LEFT JOIN s USING (message_id) WHERE NOT coalesce(gone, false)""",
)
def queue_state(spark, d):
    e = events(spark, d).withColumn("message_id", F.col("user_id") % 997)
    action = F.when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0), "delete").when(F.col("event_type") == "click", "receive").when(F.col("event_type") == "purchase", "extend").otherwise("other")
    actions = e.select("message_id", F.col("ts").alias("at"), action.alias("action"), F.when(F.col("event_id") % 2 == 0, 864000.0).alias("seconds"))
    return J.queue_state(e.where("event_type = 'view'").select("message_id", F.col("ts").alias("sent_at")), actions, "2024-01-20 00:00:00")


@query("jsonl_source", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def jsonl_source(spark, d):
    path = _place(spark, "jsonl")
    e = events(spark, d).select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value"))
    e.unionByName(spark.createDataFrame([("{broken",), ("[1]",), ("",)], "value string")).write.text(path)
    back = R.json_lines(spark, path, "event_id bigint, user_id bigint, value double")
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("url_allow_list", "SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def url_allow_list(spark, d):
    host = F.when(F.col("event_type") == "view", "files.example").when(F.col("event_type") == "click", "a.b.files.example").when(F.col("event_type") == "error", "10.0.0.1").otherwise("evilfiles.example")
    urls = events(spark, d).select("event_id", F.concat(F.lit("https://"), host, F.lit("/x.pdf")).alias("url"))
    return R.allowed_urls(urls, "url", spark.createDataFrame([("files.example",), ("10.0.0.1",)], "host string")).select("event_id")


@query("parse_response_items", "SELECT event_id, 1 AS page, 0 AS item_index, event_type AS text FROM events")
def parse_response_items(spark, d):
    payload = F.concat(F.lit('{"pages": [{"page": 1, "items": [{"text": "'), F.col("event_type"), F.lit('", "html": "<b/>"}]}]}'))
    items = R.parsed_items(events(spark, d).select("event_id", payload.alias("p")), "p", ["event_id"])
    return items.where(~F.map_contains_key("item", "html")).select("event_id", "page", "item_index", F.col("item")["text"].alias("text"))


@query("int_keyed_pages", f"WITH {PT} SELECT filing_id, page, t AS value FROM pt WHERE t IS NOT NULL")
def int_keyed_pages(spark, d):
    p = scanned(spark, d).where("t is not null").groupBy("filing_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("string"), "t"))).alias("m"))
    return R.int_keyed(p.withColumn("m", F.map_concat("m", F.create_map(F.lit("cover"), F.lit("x")))), "m", ["filing_id"])


@query("guarded_scan", "SELECT c_custkey FROM customer")
def guarded_scan(spark, d):
    return R.guarded_scan(table(spark, d, "customer").select("c_custkey"), 10**9)


@query("generation_switch", "SELECT n_nationkey, n_name, 'g2' AS generation FROM nation")
def generation_switch(spark, d):
    path, n = _place(spark, "generations"), table(spark, d, "nation").select("n_nationkey", "n_name")
    K.write_generation(n.limit(3), path, "g1")
    K.write_generation(n, path, "g2")
    return K.read_active(spark, path)


@query("upsert_sink", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT c_custkey % 7 = 0")
def upsert_sink(spark, d):
    path, c = _place(spark, "upserts"), table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.lit(1).alias("v"))
    K.upsert_partitions(spark, path, c, ["c_custkey"], "v", "c_nationkey")
    K.upsert_partitions(spark, path, c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)).withColumn("v", F.lit(2)), ["c_custkey"], "v", "c_nationkey")
    K.delete_rows(spark, path, "c_custkey % 7 = 0", "c_nationkey")
    return spark.read.parquet(path).select("c_custkey", "c_acctbal")


@query("report_sinks", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def report_sinks(spark, d):
    base = _place(spark, "reports")
    out = K.write_reports(events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), base)
    return spark.read.option("header", "true").schema("event_type string, n bigint").csv(out["csv"])


@query("artifact_sink", "SELECT r_regionkey, r_name FROM region")
def artifact_sink(spark, d):
    path = K.write_artifact(table(spark, d, "region"), _place(spark, "artifacts"), "org", "job", step="regions", version=1)
    return R.first_existing(spark, [path + "-none", path], "r_regionkey int, r_name string", multi_line=False)


@query(
    "status_throttle",
    f"""WITH RECURSIVE {ORDERED}, w AS (SELECT user_id, event_id, n, t AS last, true AS kept FROM r WHERE n = 1
UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN r.event_type = 'error' OR r.t - w.last >= 86400 THEN r.t ELSE w.last END, r.event_type = 'error' OR r.t - w.last >= 86400 FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT event_id FROM w WHERE kept""",
)
def status_throttle(spark, d):
    e = events(spark, d).withColumn("forced", F.col("event_type") == "error")
    return K.throttled(e, "user_id", "ts", "event_id", "forced", 86400).select("event_id")


@query("html_report", "SELECT '<tr><td>' || coalesce(event_type, '') || '</td><td>' || count(*) || '</td></tr>' AS value FROM events GROUP BY event_type")
def html_report(spark, d):
    out = K.write_reports(events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), _place(spark, "reports"), "Events <all>")
    return spark.read.text(out["html"]).where("value like '<tr><td>%'")


@query("moved_upserts", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'moved' ELSE 'r' || n_regionkey END AS p, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END AS v FROM nation WHERE n_nationkey <> 7 AND n_regionkey <> 3 OR n_nationkey % 4 = 0")
def moved_upserts(spark, d):
    """Rows whose partition changes leave no old copy, and a partition that loses all its rows goes."""
    path = _place(spark, "moved")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("r"), "n_regionkey").alias("p"), F.lit(1).alias("v"))
    K.upsert_partitions(spark, path, n, ["k"], "v", "p", F.col("k") != 7)
    K.upsert_partitions(spark, path, n.where("k % 4 = 0").select("k", F.lit("moved").alias("p"), F.lit(2).alias("v")), ["k"], "v", "p")
    K.delete_rows(spark, path, "p = 'r3'", "p")
    return spark.read.parquet(path).select("k", "p", "v")


@query("slot_slices", f"WITH {PT} SELECT filing_id, count(*) AS pages, md5(string_agg(coalesce(t, ''), chr(12) ORDER BY page)) AS h FROM pt GROUP BY 1")
def slot_slices(spark, d):
    return K.sliced(scanned(spark, d), ["filing_id"], "page", "t").select("filing_id", "pages", F.md5(F.col("text").cast("binary")).alias("h"))


@query(
    "redirect_chains",
    "SELECT event_id, event_type <> 'error' AND NOT (event_type = 'click' AND event_id % 3 = 0) AND event_id % 4 <> 0 AS allowed, CASE WHEN event_type = 'error' THEN 'http://files.example/' || event_id WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'https://evilfiles.example/' || event_id END AS refused FROM events",
)
def redirect_chains(spark, d):
    """Chains of two hops; every fourth resolves to a private address."""
    e = events(spark, d)
    first = F.concat(F.when(F.col("event_type") == "error", F.lit("http://files.example/")).otherwise(F.lit("https://files.example/")), F.col("event_id"))
    second = F.concat(F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), F.lit("https://evilfiles.example/")).otherwise(F.lit("https://cdn.files.example/")), F.col("event_id"))
    rows = e.select("event_id", F.array(first, second).alias("hops"), F.when(F.col("event_id") % 4 == 0, F.array(F.lit("8.8.8.8"), F.lit("10.0.0.7"))).otherwise(F.array(F.lit("8.8.8.8"), F.lit("1.1.1.1"))).alias("addresses"))
    return R.allowed_chains(rows, "event_id", "hops", spark.createDataFrame([("files.example",)], "host string"), "addresses")


@query("resumed_scan", "WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY 1 LIMIT 201) SELECT o_orderkey, CASE WHEN (SELECT count(*) FROM k) > 200 THEN (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM k ORDER BY 1 LIMIT 200)) END AS next FROM k ORDER BY 1 LIMIT 200")
def resumed_scan(spark, d):
    """A page of a scan is a limit by nature."""
    return R.page_after(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 200)


@query("catalogue_revision", "SELECT n_regionkey, count(*) AS rows, max(n_nationkey) AS version, true AS changed FROM nation GROUP BY 1")
def catalogue_revision(spark, d):
    """The state of each region's nations, and whether it changes when one name does."""
    n = table(spark, d, "nation")
    cols = ["n_nationkey", "n_name", "n_regionkey"]
    now = R.revision(n, ["n_regionkey"], "n_nationkey", cols)
    then = R.revision(n.withColumn("n_name", F.when(F.col("n_nationkey") < 25, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name"))), ["n_regionkey"], "n_nationkey", cols)
    return now.join(then.select("n_regionkey", F.col("mark").alias("other")), "n_regionkey").select("n_regionkey", "rows", "version", (F.col("mark") != F.col("other")).alias("changed"))


@query("manifest_files", "WITH f AS (SELECT DISTINCT lower(filename) AS n FROM filing_parts WHERE filename IS NOT NULL), m AS (SELECT DISTINCT lower(slot_id || '.pdf') AS n FROM filing_parts WHERE slot_id IS NOT NULL UNION SELECT lower(regexp_replace(slot_id, '_[0-9]+$', '') || '.pdf') FROM filing_parts WHERE slot_id IS NOT NULL) SELECT coalesce(m.n, f.n) AS name, CASE WHEN f.n IS NULL THEN 'missing' WHEN m.n IS NULL THEN 'unlisted' ELSE 'found' END AS state FROM f FULL JOIN m ON f.n = m.n")
def manifest_files(spark, d):
    p = table(spark, d, "filing_parts")
    listed = p.where("slot_id is not null").select(F.explode(F.array(F.concat("slot_id", F.lit(".pdf")), F.concat(F.regexp_replace("slot_id", "_[0-9]+$", ""), F.lit(".pdf")))).alias("name"))
    return R.with_manifest(p.where("filename is not null").select(F.col("filename").alias("name")), listed).withColumn("name", F.lower("name"))


@query("queue_receive", "SELECT event_id, event_type AS kind FROM events WHERE event_id % 5 <> 0")
def queue_receive(spark, d):
    """A stream of messages as text, of which every fifth is no JSON."""
    s = J.event_stream(spark, d)
    body = F.when(F.col("event_id") % 5 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))))
    return J.run_once(R.queue_messages(s.select(body.alias("value")), "value", "event_id bigint, kind string"))


@query("single_record", "WITH k AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7) SELECT c_custkey, c_name, (SELECT count(*) FROM k) > 1 AS more FROM k ORDER BY c_custkey LIMIT 1")
def single_record(spark, d):
    """The search for one record is a limit by nature."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return R.at_most_one(c, (F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 7), "c_custkey").select("c_custkey", "c_name", "more")


@query("case_types", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS \"group\" FROM nation")
def case_types(spark, d):
    """A dimension kept as one JSON document of many lines."""
    place = _place(spark, "case-types")
    whole = table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("group"))).alias("types")), {"pretty": "true"}).alias("value"))
    whole.write.text(place)
    return R.json_document(spark, place, "types array<struct<id:int,name:string,group:int>>").select(F.explode("types").alias("t")).select("t.*")
