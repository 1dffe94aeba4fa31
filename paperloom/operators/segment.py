"""Segmentation of page streams: boundary scores, cut sets, sequence and index checks, label carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import per_group


def cut_set(df: DataFrame, filing: str, label: str, page: str = "page") -> DataFrame:
    """Rows ``(filing, page)``: a boundary stands behind a page that has exactly one label, and its next page exactly one other."""
    one = df.groupBy(filing, F.col(page).alias("page")).agg(F.count_distinct(label).alias("_n"), F.min(label).alias("_l"))
    w = Window.partitionBy(filing).orderBy("page")
    nxt = one.withColumn("_np", F.lead("page").over(w)).withColumn("_nn", F.lead("_n").over(w)).withColumn("_nl", F.lead("_l").over(w))
    return nxt.where("_np = page + 1 and _n = 1 and _nn = 1 and _l <> _nl").select(filing, "page")


def boundary_scores(df: DataFrame, filing: str, page: str, label: str, confidence: Column, signals: dict[str, tuple[Column, float]], weak: str = "other", proposed: Column | None = None) -> DataFrame:
    """Rows ``(filing, page, score, action)``: additive evidence that a document begins on a page.

    ``signals`` maps names to (boolean column, weight). A page of the label before it gets at
    most 0.35, a weak one at most 0.40; a proposed cut adds 0.15, up to 1. The first page is
    1 and ``auto``. From 0.75 a cut is ``auto``, from 0.55 ``verify``, below ``skip``.
    """
    w = Window.partitionBy(filing).orderBy(page)
    score = sum((F.when(c, F.lit(x)).otherwise(F.lit(0.0)) for c, x in signals.values()), F.lit(0.0)) + F.when(confidence >= 0.8, F.lit(0.30)).otherwise(F.lit(0.0))
    capped = F.when(F.col(label) == F.lag(label).over(w), F.least(score, F.lit(0.35))).when(F.col(label) == weak, F.least(score, F.lit(0.40))).otherwise(score)
    if proposed is not None:
        capped = F.least(capped + F.when(proposed, F.lit(0.15)).otherwise(F.lit(0.0)), F.lit(1.0))
    final = F.bround(F.when(F.row_number().over(w) == 1, F.lit(1.0)).otherwise(capped), 3)
    out = df.withColumn("score", final)
    return out.select(filing, page, "score", F.when(F.col("score") >= 0.75, "auto").when(F.col("score") >= 0.55, "verify").otherwise("skip").alias("action"))


def sequence_inversions(spans: DataFrame, filing: str, label: str, start: str, ranks: dict[str, int], flexible: Sequence[str] = ()) -> DataFrame:
    """Rows ``(filing, label, previous)``: neighbours by start page whose rank goes down, flexible labels aside."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(label))
    known = spans.withColumn("_r", rank).where(F.col("_r").isNotNull() & ~F.col(label).isin(*flexible)) if flexible else spans.withColumn("_r", rank).where("_r is not null")
    w = Window.partitionBy(filing).orderBy(start, label)
    return known.withColumn("previous", F.lag(label).over(w)).withColumn("_pr", F.lag("_r").over(w)).where("_r < _pr").select(filing, label, "previous")


def index_flags(index: DataFrame, spans: DataFrame, key: str, part: str, page_count: DataFrame, count: str, tolerance: int = 1) -> DataFrame:
    """Rows ``(key, part, code, severity)``: an index's page spans against the documents' (J8, G8).

    ``index`` and ``spans`` have ``key, part, start, end``. Flags: a range past the file's
    pages, a part of the index that isn't in the file and the other way round, a start or an
    end that is off by more than ``tolerance``.
    """
    a = index.select(key, part, F.col("start").alias("_is"), F.col("end").alias("_ie"), F.lit(True).alias("_in"))
    b = spans.select(key, part, F.col("start").alias("_ds"), F.col("end").alias("_de"), F.lit(True).alias("_doc"))
    both = a.join(b, [key, part], "full_outer").join(page_count.select(key, F.col(count).alias("_n")), key, "left")
    flag = lambda cond, code, sev: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
    off = lambda x, y: F.abs(F.col(x) - F.col(y)) > tolerance
    flags = F.array_compact(
        F.array(
            flag(F.col("_ie") > F.col("_n"), "index_page_out_of_range", "error"),
            flag(F.col("_in") & F.col("_doc").isNull(), "in_index_missing_in_file", "error"),
            flag(F.col("_in") & F.col("_doc") & off("_is", "_ds"), "index_page_mismatch", "warning"),
            flag(F.col("_in") & F.col("_doc") & ~off("_is", "_ds") & off("_ie", "_de"), "index_end_page_mismatch", "error"),
            flag(F.col("_doc") & F.col("_in").isNull(), "in_file_missing_in_index", "warning"),
        )
    )
    return both.select(key, part, F.explode(flags).alias("_f")).select(key, part, "_f.code", "_f.severity")


def carried_labels(df: DataFrame, filing: str, page: str, label: str, accepted: str, short: Sequence[str]) -> DataFrame:
    """``df`` with ``carried``: each page's label carried from the last accepted start.

    A page of a ``short`` label keeps its own label and doesn't carry it on: behind it the
    label carried before goes on. State per filing, page after page: the last accepted start
    that carries is the last non-null of those before, so a window holds it.
    """
    w = Window.partitionBy(filing).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    carries = F.when(F.col(accepted) & ~F.col(label).isin(*short), F.col(label))
    return df.withColumn("carried", F.when(F.col(accepted) & F.col(label).isin(*short), F.col(label)).otherwise(F.coalesce(F.last(carries, True).over(w), F.col(label))))


def stable_owners(df: DataFrame, filing: str, page: str, label: str, opening: str) -> DataFrame:
    """``df`` with ``owner``: a page's owner stays until an opening that is verified.

    ``opening`` is true where a page opens a document by itself. Sequential per filing; pages
    of one filing are one group.
    """

    def run(rows: list[dict]) -> list[tuple]:
        owner, out = None, []
        for r in rows:
            if owner is None or r[opening] and r[label] is not None:
                owner = r[label]
            out.append((*(r[c] for c in kept), owner))
        return out

    kept = [c for c in df.columns if c != filing]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", owner string"
    return per_group(df, [filing], [page], run, schema)


def transitions(df: DataFrame, filing: str, page: str, label: str) -> DataFrame:
    """Rows ``(filing, page, label, previous)``: pages whose label differs from the page before."""
    w = Window.partitionBy(filing).orderBy(page)
    prev = df.withColumn("previous", F.lag(label).over(w)).withColumn("_n", F.row_number().over(w))
    return prev.where((F.col("_n") == 1) | ~F.col(label).eqNullSafe(F.col("previous"))).select(filing, page, label, "previous")


def ownership_faults(pages: DataFrame, filing: str, owner: str, total: DataFrame, count: str, page: str = "page") -> DataFrame:
    """Rows ``(filing, page, fault)``: pages out of range, owned twice or by nobody."""
    n = pages.groupBy(filing, F.col(page).alias("page")).agg(F.count_distinct(owner).alias("_o"))
    every = total.where(F.col(count) >= 1).select(filing, F.explode(F.sequence(F.lit(1), F.col(count))).alias("page"), F.lit(True).alias("_in"))
    both = n.join(every, [filing, "page"], "full_outer")
    fault = F.when(F.col("_in").isNull(), "out_of_range").when(F.col("_o").isNull(), "unassigned").when(F.col("_o") > 1, "several_owners")
    return both.select(filing, "page", fault.alias("fault")).where("fault is not null")


def coincident_offset(a: DataFrame, b: DataFrame, key: str, part: str) -> DataFrame:
    """Rows ``(key, offset, votes)``: the page offset that most parts of a key agree on, of equally many the smallest."""
    off = a.select(key, part, F.col("start").alias("_a")).join(b.select(key, part, F.col("start").alias("_b")), [key, part]).groupBy(key, (F.col("_b") - F.col("_a")).alias("offset")).agg(F.count("*").alias("votes"))
    return off.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), F.abs("offset"), "offset"))).where("_r = 1").drop("_r")


def proven_absent(pages: DataFrame, filing: str, label: str, wanted: DataFrame, page: str = "page") -> DataFrame:
    """Rows ``(filing, label)``: wanted labels that a filing surely lacks, as each of its pages 1..last has a label (E5).

    Where a page has none, nothing is proven.
    """
    whole = pages.where(F.col(label).isNotNull()).groupBy(filing).agg(F.count_distinct(page).alias("_n"), F.max(page).alias("_last"), F.collect_set(label).alias("_have"))
    lacks = F.array_except(wanted.select(F.collect_set("label")).scalar(), F.col("_have"))
    return whole.where("_n = _last").select(filing, F.explode(lacks).alias(label))


def incomplete_reads(required: DataFrame, read: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Rows ``(*keys, missing)``: the required pages that were not read, in order."""
    gone = required.select(*keys, page).distinct().join(read.select(*keys, page).distinct(), [*keys, page], "left_anti")
    return gone.groupBy(*keys).agg(F.sort_array(F.collect_list(page)).alias("missing"))


def stale(reports: DataFrame, active: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The reports whose stamp (a hash, a generation) isn't the active one of their keys."""
    now = active.groupBy(*keys).agg(F.max(stamp).alias("_now"))
    return reports.join(now, keys, "left").where(~F.col(stamp).eqNullSafe(F.col("_now"))).drop("_now")
