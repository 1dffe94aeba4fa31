"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, table
from .bpe import count_tokens, decode_column, encode_column
from .langid import identify
from .lines import repeated_lines, without_repeated_lines
from .mix import fair_mix, mix_report
from .names import all_names, name_links, name_variants
from .ocr import scan_noise, scan_repaired
from .pii import masked, personal_information
from .split import split_oversized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


P1_LINES = """
WITH r AS (SELECT DISTINCT record_id, file_hash, chunk_text FROM chunks WHERE regexp_matches(chunk_text, '\\S')),
s AS (SELECT file_hash, count(DISTINCT record_id) n FROM r GROUP BY 1 HAVING n >= 10),
x AS (SELECT record_id, file_hash, string_split(chunk_text, chr(10)) ls FROM r),
l AS (SELECT record_id, file_hash, unnest(ls) line, generate_subscripts(ls, 1) line_no FROM x),
k AS (SELECT record_id, file_hash, line_no, line, trim(regexp_replace(regexp_replace(lower(line), '\\s+', ' ', 'g'), '[0-9]+', '0', 'g')) key FROM l),
c AS (SELECT file_hash, key, count(DISTINCT record_id) m FROM k WHERE length(regexp_replace(key, '[^a-z]', '', 'g')) >= 12 GROUP BY 1, 2),
e AS (SELECT c.file_hash, key FROM c JOIN s ON c.file_hash IS NOT DISTINCT FROM s.file_hash WHERE m >= 5 AND m >= 0.1 * n)
"""


@query("p1_found", P1_LINES + "SELECT DISTINCT record_id, CAST(line_no AS BIGINT) AS line_no FROM k JOIN e ON k.key = e.key AND k.file_hash IS NOT DISTINCT FROM e.file_hash")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "chunks"), "file_hash", "record_id", "chunk_text", "indexed_at").select("record_id", "line_no")


@query(
    "p1_cleaned",
    P1_LINES
    + """, m AS (SELECT k.*, e.key IS NOT NULL AS hit FROM k LEFT JOIN e ON k.key = e.key AND k.file_hash IS NOT DISTINCT FROM e.file_hash),
o AS (SELECT record_id, any_value(file_hash) file_hash, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT hit), '') chunk_text, count(*) FILTER (hit) removed_lines FROM m GROUP BY 1)
SELECT file_hash, record_id, md5(chunk_text) AS text_md5, CAST(removed_lines AS INT) AS removed_lines FROM o
UNION ALL SELECT DISTINCT file_hash, record_id, md5(chunk_text), 0 FROM chunks WHERE record_id NOT IN (SELECT record_id FROM o)""",
)
def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    out = without_repeated_lines(table(spark, d, "chunks"), "file_hash", "record_id", "chunk_text", "indexed_at")
    return out.select("file_hash", "record_id", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), "removed_lines")


@query(
    "p1_over_copies",
    """
WITH r AS (SELECT DISTINCT record_id, file_hash, chunk_text, trim(regexp_replace(trim(chunk_text), '\\s+', ' ', 'g')) c, CAST(indexed_at AS DATE) d FROM chunks WHERE regexp_matches(chunk_text, '\\S')),
s AS (SELECT file_hash, count(DISTINCT c) n FROM r GROUP BY 1 HAVING n >= 10),
x AS (SELECT record_id, file_hash, c, d, string_split(chunk_text, chr(10)) ls FROM r),
l AS (SELECT record_id, file_hash, c, d, unnest(ls) line, generate_subscripts(ls, 1) line_no FROM x),
k AS (SELECT record_id, file_hash, c, d, line_no, trim(regexp_replace(regexp_replace(lower(line), '\\s+', ' ', 'g'), '[0-9]+', '0', 'g')) key FROM l),
p AS (SELECT file_hash, key, c, min(d) d FROM k WHERE length(regexp_replace(key, '[^a-z]', '', 'g')) >= 12 GROUP BY 1, 2, 3),
m AS (SELECT file_hash, key, count(*) m, greatest(count(DISTINCT d), 1) dd FROM p GROUP BY 1, 2),
e AS (SELECT m.file_hash, key FROM m JOIN s ON m.file_hash IS NOT DISTINCT FROM s.file_hash WHERE m >= 5 AND m >= 0.1 * n AND dd >= 2)
SELECT DISTINCT record_id, CAST(line_no AS BIGINT) AS line_no FROM k JOIN e ON k.key = e.key AND k.file_hash IS NOT DISTINCT FROM e.file_hash""",
)
def p1_over_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies of a text collapse into one cluster, whatever their ids, and a line must come on two dates at least: text published again is no boilerplate."""
    found = repeated_lines(table(spark, d, "chunks"), "file_hash", "record_id", "chunk_text", "indexed_at", cluster_by="text", min_dates=2)
    return found.select("record_id", "line_no")


def _pieces(spark: SparkSession, d: str, **more) -> DataFrame:
    return split_oversized(table(spark, d, "chunks"), ["chunk_index"], ["file_hash", "primary_page"], "record_id", "chunk_text", **more)


@query("p4_found", "SELECT DISTINCT record_id FROM chunks WHERE length(chunk_text) > 3500")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, only_oversized=True).where("part = 1").select("record_id")


@query("p4_pieces")
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


@query("p4_reassembled", "SELECT DISTINCT record_id, md5(chunk_text) AS text_md5, true AS fits FROM chunks WHERE chunk_text IS NOT NULL")
def p4_reassembled(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together again from what each piece adds to those before it, and whether all pieces keep to the limit and the overlap."""
    p = _pieces(spark, d).select("record_id", "part", "start", "piece")
    whole = p.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("part", "start", "piece"))).alias("_p"))
    end = lambda x: x["start"] + F.length(x["piece"])
    joined = F.aggregate("_p", F.struct(F.lit("").alias("t"), F.lit(True).alias("ok")), lambda a, x: F.struct(F.concat(a["t"], F.substring(x["piece"], F.length(a["t"]) - x["start"] + 1, F.length(x["piece"]))).alias("t"), (a["ok"] & (F.length(x["piece"]) <= 3500) & (F.length(a["t"]) - x["start"]).between(0, 200) & ((end(x) > F.length(a["t"])) | (x["part"] == 0))).alias("ok")))
    return whole.select("record_id", joined.alias("j")).select("record_id", F.md5(F.col("j.t").cast("binary")).alias("text_md5"), F.col("j.ok").alias("fits"))


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


@query("p7_round_trip", "SELECT doc_id, coalesce(text, '') = coalesce(text, '') AS same, md5(coalesce(text, '')) AS text_md5 FROM documents")
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = decode_column(spark, encode_column(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "decoded")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("decoded")).alias("same"), F.md5(F.col("decoded").cast("binary")).alias("text_md5"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents").where("text is not null"), ["doc_id", "source"], "text")


def _mix(spark: SparkSession, d: str) -> DataFrame:
    return fair_mix(materialise(_sized(spark, d)), table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens")


@query("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


@query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(_mix(spark, d), table(spark, d, "mix_targets"), "source", "n_tokens")


@query("p8_fair", "SELECT DISTINCT t.source, true AS within_repeats, true AS in_share FROM mix_targets t WHERE target_weight > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text <> '')")
def p8_fair(spark: SparkSession, d: str) -> DataFrame:
    """Of each source in the mix: no document comes more often than it may, nor a round before the last one is through, and its size is its share, to within a largest document."""
    sized = materialise(_sized(spark, d))
    targets = table(spark, d, "mix_targets").where("target_weight > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r"))
    mix = fair_mix(sized, table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens")
    per = mix.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("repeat_no").alias("top"), F.count_distinct("doc_id").alias("docs"), F.count("*").alias("copies"))
    both = sized.where("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("most")).join(targets, "source").join(per, "source", "left")
    whole, n = Window.partitionBy(), F.coalesce("n", F.lit(0))
    share = F.col("w") / F.sum("w").over(whole) * F.sum("n").over(whole)
    rounds = (F.col("top") <= F.col("r")) & ((F.col("top") == 1) | (F.col("copies") > (F.col("top") - 1) * F.col("docs")))
    return both.select("source", F.coalesce(rounds, F.lit(True)).alias("within_repeats"), F.coalesce(F.abs(n - share) <= F.max("most").over(whole), F.lit(True)).alias("in_share"))


@query("p9_languages")
def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return identify(table(spark, d, "documents"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = identify(table(spark, d, "documents"))
    return found.where("lang is not null and (segment_no > 0 or not label_ok)").select("doc_id", "segment_no", "lang").distinct()


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise(spark, table(spark, d, "chunks"), table(spark, d, "page_text"))


@query("p6_repaired")
def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repaired(spark, table(spark, d, "chunks"), table(spark, d, "page_text"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants(table(spark, d, "filings"), table(spark, d, "nicknames"))


@query("p5_classes")
def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    classes = name_links(all_names(table(spark, d, "filings")), table(spark, d, "nicknames"))
    return classes.select("name", F.min("name").over(Window.partitionBy("comp")).alias("class_name"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(table(spark, d, "chunks"), table(spark, d, "finding_evidence"))


@query("p3_masked")
def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    return masked(table(spark, d, "chunks"), table(spark, d, "finding_evidence"))
