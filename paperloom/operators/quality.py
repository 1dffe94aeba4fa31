"""Validation of records and annotations, matching of predicted to true spans, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import per_group


def issues(df: DataFrame, ident: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Rows ``(ident, code, severity)``: the rules (code, severity, condition) that a row breaks (V1); one pass, no join."""
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules]))
    return df.select(ident, F.explode(flags).alias("_f")).select(ident, "_f.code", "_f.severity")


def validation_summary(found: DataFrame, rows: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Per key rows, errors, warnings and whether it passes: no error."""
    per = found.groupBy(ident).agg(F.count_if(F.col("severity") == "error").alias("_e"), F.count_if(F.col("severity") == "warning").alias("_w"))
    joined = rows.select(*keys, ident).distinct().join(per, ident, "left")
    out = joined.groupBy(*keys).agg(F.count("*").alias("records"), F.coalesce(F.sum("_e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("_w"), F.lit(0)).alias("warnings"))
    return out.withColumn("passed", F.col("errors") == 0)


def annotation_faults(df: DataFrame, case: str, doc: str, start: str, end: str, count: str) -> DataFrame:
    """Rows ``(case, document, fault)`` of ground truth: bad ranges, repeated ids, overlaps, uncovered pages (V2)."""
    one = df.select(F.col(case).alias("case_id"), F.col(doc).alias("document_id"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(count).alias("_n")).distinct()
    bad = F.col("_s").isNull() | F.col("_e").isNull() | (F.col("_s") < 1) | (F.col("_s") > F.col("_e")) | (F.col("_e") > F.col("_n"))
    out_of = one.where(bad).select("case_id", "document_id", F.lit("bad_range").alias("fault"))
    twice = one.groupBy("case_id", "document_id").agg(F.count("*").alias("_k")).where("_k > 1").select("case_id", "document_id", F.lit("repeated_id").alias("fault"))
    good = one.where(~bad)
    w = Window.partitionBy("case_id").orderBy("_s", "_e", "document_id")
    seen = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ordered = good.withColumn("_m", seen)
    over = ordered.where("_s <= _m").select("case_id", "document_id", F.lit("overlap").alias("fault"))
    holes = ordered.where("_s > coalesce(_m, 0) + 1").select("case_id", "document_id", F.lit("gap_before").alias("fault"))
    tail = good.groupBy("case_id").agg(F.max("_e").alias("_m"), F.max("_n").alias("_n")).where("_m < _n").select("case_id", F.lit(None).cast("string").alias("document_id"), F.lit("uncovered_end").alias("fault"))
    return out_of.unionByName(twice).unionByName(over).unionByName(holes).unionByName(tail).distinct()


def heaviest_matching(links: dict[tuple, int]) -> set[tuple]:
    """The links ``(left, right): weight`` of a one-to-one matching of greatest total weight.

    Works on the links alone, not on a square of all pairs: as long as it adds weight, the
    best chain of swaps is looked for that begins at a left end without a partner, hands
    right ends over from holder to holder, and ends at a right end nobody holds.
    """
    wishes: dict = {}
    for (left, right), w in sorted(links.items()):
        wishes.setdefault(left, []).append((right, w))
    holder: dict = {}
    while True:
        held = set(holder.values())
        gain = {left: 0 for left in wishes if left not in held}
        came: dict = {}
        best = None
        pending = list(gain)
        while pending:
            later = []
            for left in dict.fromkeys(pending):
                for right, w in wishes[left]:
                    total = gain[left] + w
                    other = holder.get(right)
                    if other is None:
                        if total > 0 and (best is None or total > best[0]):
                            best = (total, left, right)
                    elif other != left and total - links[other, right] > gain.get(other, float("-inf")):
                        gain[other] = total - links[other, right]
                        came[other] = (left, right)
                        later.append(other)
            pending = later
        if best is None:
            return {(left, right) for right, left in holder.items()}
        _, left, right = best
        while True:
            holder[right] = left
            if left not in came:
                break
            left, right = came[left]


def matched_spans(truth: DataFrame, predicted: DataFrame, case: str) -> DataFrame:
    """Rows ``(case, true_id, predicted_id, overlap, same_type, exact)``: the one-to-one matching of spans of greatest overlap.

    Both sides have ``case, id, type, start, end``. The overlaps come from an equi-join on
    (case, page); only the pairs that overlap reach the assignment, one case at a time.
    """
    pages = lambda df, p: df.where("start >= 1 and start <= end").select(case, F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_t"), F.col("start").alias(f"{p}_s"), F.col("end").alias(f"{p}_e"), F.explode(F.sequence("start", "end")).alias("_page"))
    pairs = pages(truth, "t").join(pages(predicted, "p"), [case, "_page"]).groupBy(case, "t_id", "p_id").agg(F.count("*").alias("overlap"), F.bool_and(F.col("t_t").eqNullSafe(F.col("p_t"))).alias("same_type"), F.bool_and((F.col("t_s") == F.col("p_s")) & (F.col("t_e") == F.col("p_e"))).alias("exact"))

    def run(rows: list[dict]) -> list[tuple]:
        # overlap decides, then the number of equal types, then of equal ends
        more = len(rows) + 1
        chosen = heaviest_matching({(r["t_id"], r["p_id"]): (r["overlap"] * more + r["same_type"]) * more + r["exact"] for r in rows})
        return [(r["t_id"], r["p_id"], r["overlap"], r["same_type"], r["exact"]) for r in rows if (r["t_id"], r["p_id"]) in chosen]

    return per_group(pairs, [case], ["t_id", "p_id"], run, "true_id string, predicted_id string, overlap bigint, same_type boolean, exact boolean")


def boundary_counts(truth: DataFrame, predicted: DataFrame, case: str) -> DataFrame:
    """Rows ``(case, hits, predicted, expected)``: boundaries (``case, page``) found, predicted and true (M1)."""
    t, p = truth.select(case, "page").distinct().withColumn("_t", F.lit(1)), predicted.select(case, "page").distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [case, "page"], "full_outer")
    return both.groupBy(case).agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("hits"), F.count("_p").alias("predicted"), F.count("_t").alias("expected"))


def page_ownership(truth: DataFrame, predicted: DataFrame, case: str) -> DataFrame:
    """Rows ``(case, pages, missing, several, right, accuracy)``: true pages (``case, page, owner``) against the predicted owners (M1)."""
    p = predicted.groupBy(case, "page").agg(F.count_distinct("owner").alias("_n"), F.min("owner").alias("_o"))
    t = truth.groupBy(case, "page").agg(F.min("owner").alias("owner"))
    both = t.join(p, [case, "page"], "left")
    out = both.groupBy(case).agg(F.count("*").alias("pages"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("several"), F.count_if((F.col("_n") == 1) & (F.col("_o") == F.col("owner"))).alias("right"))
    return out.withColumn("accuracy", F.bround(F.try_divide("right", "pages"), 6))


def collapsed_parties(df: DataFrame, filing: str, order: str, name: str, guardian: str, richness: Column) -> DataFrame:
    """``df`` with ``party``: the place of the first of the same person's rows in its filing, and of those only the richest.

    Names are the same if equal, one within the other, or two edits apart; with equal
    guardians in the first word only. Greedy in the order given, one filing at a time.
    """
    def same(a: tuple, b: tuple) -> bool:
        x, y = a[0], b[0]
        if not x or not y:
            return False
        if x == y or (len(x) > 4 and x in y) or (len(y) > 4 and y in x) or edits(x, y, 2):
            return True
        return bool(a[1]) and a[1] == b[1] and x.split()[0] == y.split()[0]

    def run(rows: list[dict]) -> list[tuple]:
        fold = lambda s: " ".join(s.lower().split()) if isinstance(s, str) else ""
        keys = [(fold(r[name]), fold(r[guardian])) for r in rows]
        best: dict[int, dict] = {}
        for i, (r, k) in enumerate(zip(rows, keys)):
            at = next((h for h in best if same(keys[h], k)), i)
            if at not in best or r["_rich"] > best[at]["_rich"]:
                best[at] = r
        return [(*(r[c] for c in kept), at) for at, r in best.items()]

    kept = [c for c in df.columns if c != filing]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", party int"
    return per_group(df.withColumn("_rich", richness), [filing], [order], run, schema)


def edits(a: str, b: str, limit: int) -> bool:
    """Whether two texts are at most ``limit`` edits apart."""
    if abs(len(a) - len(b)) > limit:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        if min(row) > limit:
            return False
    return row[-1] <= limit


def packed_batches(df: DataFrame, key: str, order: str, pages: str, most: int = 4) -> DataFrame:
    """``df`` with ``batch``: plans packed first-fit into batches of at most ``most`` distinct pages."""
    def run(rows: list[dict]) -> list[tuple]:
        bins: list[set] = []
        out = []
        for r in rows:
            want = set(r[pages] or ())
            at = next((i for i, b in enumerate(bins) if len(b | want) <= most), len(bins))
            if at == len(bins):
                bins.append(set())
            bins[at] |= want
            out.append((*(r[c] for c in kept), at))
        return out

    kept = [c for c in df.columns if c != key]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", batch int"
    return per_group(df, [key], [order], run, schema)


def set_issues(df: DataFrame, scope: str, generation: str, kind: str, logical: Sequence[str], page: str, content: str, paged: Sequence[str] = ("page", "page_manifest")) -> DataFrame:
    """Rows ``(scope, generation, code, severity, subject)``: what is wrong with the records of a generation together (V1).

    missing_summary, duplicate_summary; duplicate_logical_chunk (records of one ``logical`` key), duplicate_content (page
    records of one content), page_coverage_gap (each run of pages between the first and the last that no record is of),
    multiple_generations of a scope. Counts are combined before they are shuffled; gaps come from neighbouring pages.
    """
    rows = df.select(*dict.fromkeys([scope, generation, kind, *logical, page, content]))
    keys = [scope, generation]
    row = lambda d, code, severity, subject: d.select(scope, generation, F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))
    sums = rows.groupBy(*keys).agg(F.count_if(F.col(kind) == "summary").alias("_n"))
    pages = rows.where(F.col(kind).isin(*paged))
    twice = pages.groupBy(*keys, *logical).agg(F.count("*").alias("_n")).where("_n > 1")
    again = rows.where((F.col(kind) == "page") & (F.trim(F.col(content)) != "")).groupBy(*keys, content).agg(F.count("*").alias("_n")).where("_n > 1")
    w = Window.partitionBy(*keys).orderBy(page)
    gaps = pages.where(F.col(page).isNotNull()).select(*keys, page).distinct().withColumn("_next", F.lead(page).over(w)).where(F.col("_next") > F.col(page) + 1)
    several = rows.select(*keys).distinct().groupBy(scope).agg(F.count("*").alias("_n")).where("_n > 1").withColumn(generation, F.lit(None).cast(df.schema[generation].dataType))
    return (
        row(sums.where("_n = 0"), "missing_summary", "warning", F.lit(None))
        .unionByName(row(sums.where("_n > 1"), "duplicate_summary", "error", F.col("_n")))
        .unionByName(row(twice, "duplicate_logical_chunk", "error", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in logical])))
        .unionByName(row(again, "duplicate_content", "warning", F.col(content)))
        .unionByName(row(gaps, "page_coverage_gap", "warning", F.concat_ws("-", F.col(page) + 1, F.col("_next") - 1)))
        .unionByName(row(several, "multiple_generations", "warning", F.col("_n")))
    )


def scan_issues(listed: DataFrame, fetched: DataFrame, ident: str, asked: DataFrame, scope: str) -> DataFrame:
    """Rows ``(code, severity, subject)``: ids that were listed but not fetched, scopes asked for that have no record (V1)."""
    lost = listed.select(ident).distinct().join(fetched.select(ident), ident, "left_anti").select(F.lit("listed_record_not_fetched").alias("code"), F.col(ident).cast("string").alias("subject"))
    none = asked.select(scope).distinct().join(fetched.select(scope), scope, "left_anti").select(F.lit("workspace_not_found").alias("code"), F.col(scope).cast("string").alias("subject"))
    return lost.unionByName(none).select("code", F.lit("error").alias("severity"), "subject")


def case_metrics(truth: DataFrame, predicted: DataFrame, matched: DataFrame, rows: DataFrame, counts: DataFrame, case: str) -> DataFrame:
    """Per case how right a split is beyond its boundaries (M1).

    ``truth`` has ``case, id, flags``; ``predicted`` ``case, id, needs_review``; ``matched`` comes of :func:`matched_spans`; ``rows`` has
    the predicted page rows ``case, page, slots, needs_review``; ``counts`` ``case, page_count``. Rates over nothing are null.
    """
    t = truth.groupBy(case).agg(F.count_distinct("id").alias("expected"), F.count_if(F.size("flags") > 0).alias("ambiguous"))
    p = predicted.groupBy(case).agg(F.count_distinct("id").alias("segments"), F.count_if("needs_review").alias("reviewed"))
    m = matched.groupBy(case).agg(F.count("*").alias("matched"), F.count_if("exact").alias("exact"), F.count_if("same_type").alias("typed"))
    inside = F.col("page").between(1, F.col("page_count"))
    per = rows.join(counts, case).groupBy(case, "page_count", "page").agg(F.count("*").alias("_rows"), F.size(F.array_distinct(F.flatten(F.collect_list("slots")))).alias("_slots"), F.bool_or("needs_review").alias("_review"))
    seen = per.groupBy(case).agg(
        F.count_if(inside & (F.col("_slots") > 0)).alias("_owned"),
        F.count_if(inside & ((F.col("_slots") > 1) | (F.col("_slots") > 0) & (F.col("_rows") > 1))).alias("several"),
        F.count_if(~inside).alias("out_of_range"),
        F.count_if(inside & F.col("_review")).alias("review_pages"),
    )
    out = counts
    for df in (t, p, m, seen):
        out = out.join(df, case, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rate = lambda a, b: F.bround(F.try_divide(zero(a), zero(b)), 6)
    return out.select(
        case,
        rate("exact", "expected").alias("range_accuracy"),
        rate("typed", "matched").alias("type_accuracy"),
        rate("reviewed", "segments").alias("manual_review_rate"),
        rate("review_pages", "page_count").alias("review_page_rate"),
        zero("ambiguous").alias("ambiguous"),
        (F.col("page_count") - zero("_owned")).alias("missing"),
        zero("several").alias("several"),
        zero("out_of_range").alias("out_of_range"),
        (zero("expected") - zero("matched")).alias("unmatched_true"),
        (zero("segments") - zero("matched")).alias("unmatched_predicted"),
    )
