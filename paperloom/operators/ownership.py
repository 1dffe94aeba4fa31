"""Which document owns a page: labels of segments, refined boundaries, numbered families, precedence, audit.

All work is joins on (case, page), windows over one case's pages and expressions over arrays
of one range's marks; the long way from segments to pages is ``explode(sequence)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import islands, kept_runs


def segment_page_labels(segments: DataFrame, case: str, order: str, label: str, pages: str, ignored: Sequence[str] = ()) -> DataFrame:
    """Rows ``(case, page, labels)``: the labels of all segments over a page, each once, in the segments' order.

    Null pages and null, blank or ``ignored`` labels give nothing; a page no segment holds has no row.
    """
    name = F.trim(F.col(label))
    rows = segments.where((name != "") & ~F.coalesce(name.isin(list(ignored)), F.lit(False))).select(case, F.col(order).alias("_o"), name.alias("_l"), F.explode(pages).alias("page")).where("page is not null")
    seen = F.sort_array(F.collect_list(F.struct("_o", "_l")))
    return rows.groupBy(case, "page").agg(F.array_distinct(F.transform(seen, lambda x: x["_l"])).alias("labels"))


def refined_by_marks(ranges: DataFrame, marks: DataFrame, case: str, segment: str, start: str, end: str) -> DataFrame:
    """Rows ``(case, segment, piece, start, end)``: ranges cut where the next mark of their own series stands.

    ``marks`` has ``case, page, series, number``. A range whose first page has a mark is cut at the first
    later page with the number behind it, and so on from there; other marks cut nothing.
    Only the marks of a range's own series are gathered, in order, and folded.
    """
    m = marks.select(F.col(case).alias("_c"), F.col("page").alias("_p"), F.col("series").alias("_s"), F.col("number").alias("_n"))
    first = ranges.join(m, (F.col(case) == F.col("_c")) & (F.col(start) == F.col("_p")), "left").groupBy(case, segment, start, end).agg(F.min(F.struct("_s", "_n")).alias("_first"))
    inside = first.join(m, (F.col(case) == F.col("_c")) & (F.col("_p") > F.col(start)) & (F.col("_p") <= F.col(end)) & (F.col("_s") == F.col("_first._s")), "left")
    got = inside.groupBy(case, segment, start, end).agg(F.min("_first").alias("_first"), F.sort_array(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_n")))).alias("_m"))
    begin = F.struct(F.col("_first._n").cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("cuts"))
    walk = F.aggregate("_m", begin, lambda acc, x: F.when(x["_n"] == acc["n"] + 1, F.struct(x["_n"].cast("bigint").alias("n"), F.array_append(acc["cuts"], x["_p"].cast("bigint")).alias("cuts"))).otherwise(acc))
    starts = F.concat(F.array(F.col(start).cast("bigint")), walk["cuts"])
    cut = got.select(case, segment, F.col(end).cast("bigint").alias("_e"), starts.alias("_starts"))
    return cut.select(case, segment, "_e", "_starts", F.posexplode("_starts").alias("_i", "start")).select(case, segment, (F.col("_i") + 1).alias("piece"), "start", F.coalesce(F.try_element_at("_starts", F.col("_i") + 2) - 1, F.col("_e")).alias("end"))


def refined_by_openings(ranges: DataFrame, classified: DataFrame, case: str, segment: str, single: str = "cover") -> DataFrame:
    """Rows ``(case, segment, piece, start, end)``: ranges cut at the classifier's openings (R2).

    ``ranges`` has ``case, segment, start, end``; ``classified`` ``case, start, end, category, supported``. Neighbours
    of one category run together. A range is cut only if the pieces inside it cover it whole and in order; then
    each piece begins a cut if its opening is ``supported``, or if a ``single`` of one page ends before it.
    """
    c = classified.select(F.col(case).alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("category").alias("_k"), F.col("supported").alias("_ok"))
    inside = ranges.join(c, (F.col(case) == F.col("_c")) & (F.col("_s") >= F.col("start")) & (F.col("_e") <= F.col("end")))
    w = Window.partitionBy(case, segment, "start", "end").orderBy("_s", "_e", "_k")
    same = (F.lag("_k").over(w) == F.col("_k")) & (F.lag("_e").over(w) + 1 == F.col("_s"))
    runs = inside.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w)).groupBy(case, segment, "start", "end", "_run").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.first("_k").alias("_k"), F.min_by("_ok", "_s").alias("_ok"), F.sum(F.col("_e") - F.col("_s") + 1).alias("_pages"))
    v = Window.partitionBy(case, segment, "start", "end").orderBy("_run")
    follows = F.coalesce(F.lag("_e").over(v) + 1, F.col("start")) == F.col("_s")
    alone = (F.lag("_k").over(v) == single) & (F.lag("_pages").over(v) == 1) & (F.col("_k") != single)
    steps = runs.withColumn("_follows", follows & (F.col("_pages") == F.col("_e") - F.col("_s") + 1)).withColumn("_cut", (F.col("_s") > F.col("start")) & (F.coalesce("_ok", F.lit(False)) | F.coalesce(alone, F.lit(False))))
    whole = steps.groupBy(case, segment, "start", "end").agg((F.bool_and("_follows") & (F.max("_e") == F.col("end"))).alias("_whole"), F.sort_array(F.collect_set(F.when(F.col("_cut"), F.col("_s")))).alias("_cuts"))
    key = [case, segment, "start", "end"]
    every = ranges.select(*key).join(whole, key, "left").withColumn("_starts", F.when(F.coalesce("_whole", F.lit(False)), F.concat(F.array("start"), "_cuts")).otherwise(F.array("start")))
    piece = every.select(case, segment, F.col("end").alias("_e"), "_starts", F.posexplode("_starts").alias("_i", "start"))
    return piece.select(case, segment, (F.col("_i") + 1).alias("piece"), "start", F.coalesce(F.try_element_at("_starts", F.col("_i") + 2) - 1, F.col("_e")).alias("end"))


def numbered_families(pages: DataFrame, case: str, label: str, number: str, families: Sequence[str]) -> DataFrame:
    """Rows ``(case, page, label)``: pages of a family under the number printed last, and of each label only the run that counts.

    ``pages`` has ``case, page, label, number``, the number where a page's heading prints one. Within a contiguous run of a
    family a page without one belongs to the last; pages before the first stay under the family's own name.
    Of numbered labels the first contiguous run is kept, of others the longest.
    """
    rows = pages.select(case, "page", F.col(label).alias("_l"), F.col(number).alias("_n")).distinct()
    w = Window.partitionBy(case, "_l").orderBy("page")
    run = rows.withColumn("_run", F.col("page") - F.dense_rank().over(w))
    v = Window.partitionBy(case, "_l", "_run").orderBy("page", "_n").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_n", True).over(v)
    named = run.withColumn("_name", F.when(F.col("_l").isin(list(families)) & last.isNotNull(), F.concat_ws("_", "_l", last.cast("string"))).otherwise(F.col("_l")))
    kept = kept_runs(islands(named.select(case, F.col("_name").alias("label"), "page"), [case, "label"]), case, "label", [], F.regexp_extract("label", r"^(.*)_\d+$", 1).isin(list(families)))
    return kept.select(case, "label", F.explode(F.sequence("start", "end")).alias("page"))


def owned_pages(pages: DataFrame, case: str, sources: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Rows ``(case, page, owner, source, needs_review)``: the owner by the first source that names one.

    ``sources`` are (name, owner, whether it may decide) in order of precedence. A page needs review if no
    source decides, or if a later one that may names another owner.
    """
    may = [F.when(F.coalesce(ok, F.lit(False)), owner) for _, owner, ok in sources]
    owner = F.coalesce(*may)
    source = F.coalesce(*[F.when(m.isNotNull(), F.lit(name)) for m, (name, _, _) in zip(may, sources)])
    others = F.size(F.array_distinct(F.array_compact(F.array(*may)))) > 1
    return pages.select(case, "page", owner.alias("owner"), source.alias("source"), (owner.isNull() | others).alias("needs_review"))


def review_reasons(case: str, *reports: tuple[DataFrame, str]) -> DataFrame:
    """Rows ``(case, page, reasons)``: the reasons of several reports (``case, page``, and each one's column) per page, sorted, each once."""
    rows = None
    for df, reason in reports:
        one = df.select(case, "page", F.col(reason).alias("_r")).where("page is not null and _r is not null")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(case, "page").agg(F.array_sort(F.collect_set("_r")).alias("reasons"))


def repeated_segments(pages: DataFrame, segments: DataFrame, taken: DataFrame, case: str) -> DataFrame:
    """Rows ``(case, number, start, end, pages)``: a family's pages cut into documents by the segments that hold them.

    ``pages`` has ``case, page``, ``segments`` ``case, segment, start, end``, ``taken`` ``case, number``. A page belongs to the first of
    its segments, in order of the segment; what none holds forms documents of its contiguous runs. Documents are numbered in that order,
    numbers that are taken passed over.
    """
    p = pages.select(case, "page").distinct()
    over = segments.where("start >= 1 and start <= end").select(case, F.col("segment").alias("_seg"), F.explode(F.sequence("start", "end")).alias("page")).groupBy(case, "page").agg(F.min("_seg").alias("_seg"))
    owned = p.join(over, [case, "page"], "left")
    held = owned.where("_seg is not null").groupBy(case, "_seg").agg(F.min("page").alias("start"), F.max("page").alias("end"), F.count("*").alias("pages")).select(case, F.lit(0).alias("_late"), F.col("_seg").cast("bigint").alias("_ord"), "start", "end", "pages")
    left = islands(owned.where("_seg is null"), [case]).select(case, F.lit(1).alias("_late"), F.col("start").cast("bigint").alias("_ord"), "start", "end", "pages")
    every = held.unionByName(left).withColumn("_k", F.row_number().over(Window.partitionBy(case).orderBy("_late", "_ord")))
    gone = taken.groupBy(case).agg(F.collect_set(F.col("number").cast("int")).alias("_gone"))
    free = every.join(gone, case, "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    number = F.element_at(F.array_except(F.sequence(F.lit(1), F.col("_k") + F.size("_gone")), "_gone"), F.col("_k"))
    return free.select(case, number.alias("number"), "start", "end", "pages")


def audit_flags(cases: DataFrame, case: str, index_pages: Column, index_rows: Column, pages: Column, classified_pages: Column, owners_in_conflict: Column, open_transitions: Column) -> DataFrame:
    """Rows ``(case, code, severity)`` of a case's split as a whole (G8): counts of the case as columns, in one pass."""
    rules = [
        ("index_missing", "warning", index_pages == 0),
        ("index_unparsed", "warning", (index_pages > 0) & (index_rows == 0)),
        ("segment_classification_incomplete", "warning", classified_pages < pages),
        ("split_ownership_conflict", "warning", owners_in_conflict > 0),
        ("unresolved_source_transition", "warning", open_transitions > 0),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules]))
    return cases.select(case, F.explode(found).alias("_f")).select(case, "_f.code", "_f.severity")


def mention_flags(mentioned: DataFrame, attached: DataFrame, case: str, label: str) -> DataFrame:
    """Rows ``(case, label, code, severity)``: labels mentioned but not attached (error), and attached but not mentioned (warning)."""
    m, a = mentioned.select(case, label).distinct(), attached.select(case, label).distinct()
    lost = m.join(a, [case, label], "left_anti").select(case, label, F.lit("annexure_mentioned_not_attached").alias("code"), F.lit("error").alias("severity"))
    extra = a.join(m, [case, label], "left_anti").select(case, label, F.lit("annexure_attached_not_mentioned").alias("code"), F.lit("warning").alias("severity"))
    return lost.unionByName(extra)
