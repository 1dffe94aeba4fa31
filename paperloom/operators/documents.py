"""Reading of page texts: types, index rows, folios, headings, fields, label repair and reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType



def classified(df: DataFrame, text: str, rules: Sequence[tuple[str, str, float]], hint: str | None = None, default: str = "other") -> DataFrame:
    """``df`` with ``type``, ``confidence``, ``signals``: the first rule (pattern, type, confidence) a text matches.

    ``signals`` are the types of all rules that match. A ``hint`` that agrees adds 0.05, one
    where no rule matches is taken with 0.58.
    """
    t = F.coalesce(text, F.lit(""))
    hits = F.array_compact(F.array(*[F.when(t.rlike(p), F.struct(F.lit(k).alias("type"), F.lit(float(c)).alias("confidence"))) for p, k, c in rules]))
    out = df.withColumn("_h", hits).withColumn("_f", F.try_element_at("_h", F.lit(1)))
    kind, sure = F.coalesce("_f.type", F.lit(default)), F.coalesce("_f.confidence", F.lit(0.0))
    if hint:
        sure = F.when(F.col("_f").isNull() & F.col(hint).isNotNull(), 0.58).when(F.col(hint) == F.col("_f.type"), F.least(sure + 0.05, F.lit(1.0))).otherwise(sure)
        kind = F.coalesce("_f.type", hint, F.lit(default))
    return out.select(*df.columns, kind.alias("type"), F.bround(sure, 3).alias("confidence"), F.array_distinct(F.transform("_h", lambda x: x["type"])).alias("signals"))


def table_rows(df: DataFrame, keep: Sequence[str], text: str, fields: Sequence[str]) -> DataFrame:
    """Rows ``(*keep, line_no, *fields)``: lines of exactly as many ``|`` cells as fields, beginning with a serial number."""
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("_n", "_line")).where(F.col("_line").contains("|"))
    cells = lines.select(*keep, (F.col("_n") + 1).alias("line_no"), F.transform(F.split(F.btrim("_line", F.lit("| ")), r"\|"), lambda x: F.trim(x)).alias("_c"))
    good = cells.where((F.size("_c") == len(fields)) & F.col("_c")[0].rlike(r"^\d{1,4}\.?$"))
    return good.select(*keep, "line_no", *[F.col("_c")[i].alias(f) for i, f in enumerate(fields)])


def printed_folios(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """Rows ``(*keep, folio, form)``: the printed number of a page, decorated forms before bare ones, the last line before the first."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    with_lines = df.select(*keep, lines.alias("_l")).where(F.size("_l") > 0)
    ends = F.array_distinct(F.array(F.element_at("_l", -1), F.element_at("_l", 1)))
    forms = [("page_of", r"(?i)^page\s+(\d{1,5})\s+of\s+\d{1,5}$"), ("page_no", r"(?i)^(?:pg|page)\.?\s*(?:no\.?)?\s*(\d{1,5})$"), ("dashed", r"^[-—–\[(]\s*(\d{1,5})\s*[-—–\])]$"), ("bare", r"^(\d{1,5})$")]

    def of_form(form: str, pattern: str) -> Column:
        lines = F.filter(ends, lambda x: x.rlike(pattern))
        return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).cast("int").alias("folio"), F.lit(form).alias("form")))

    found = F.flatten(F.array(*[of_form(f, p) for f, p in forms]))
    return with_lines.withColumn("_f", F.try_element_at(found, F.lit(1))).where("_f is not null").select(*keep, "_f.folio", "_f.form")


def heading_segments(df: DataFrame, keep: Sequence[str], text: str, heading: str) -> DataFrame:
    """Rows ``(*keep, label, particulars)``: what stands between a heading and the next (R39, R34); of a repeated label the first."""
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("_n", "_line"))
    w = Window.partitionBy(*keep).orderBy("_n")
    marked = lines.withColumn("_h", F.col("_line").rlike(heading)).withColumn("_k", F.sum(F.col("_h").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_k > 0")
    seg = marked.groupBy(*keep, "_k").agg(F.min_by("_line", "_n").alias("label"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("_h"), F.struct("_n", "_line")))), lambda x: F.trim(x["_line"])), " ").alias("particulars"))
    first = seg.withColumn("label", F.trim("label")).withColumn("_r", F.row_number().over(Window.partitionBy(*keep, "label").orderBy("_k"))).where("_r = 1")
    return first.select(*keep, "label", F.trim("particulars").alias("particulars"))


def propagated_labels(df: DataFrame, filing: str, page: str, stamp: str) -> DataFrame:
    """``df`` with ``label``: a stamp is carried forward to the next; pages before the first get the first."""
    w = Window.partitionBy(filing).orderBy(page)
    ahead = F.last(stamp, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(stamp, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("label", F.coalesce(ahead, back))


def anchor_phrases(c: str | Column, triggers: Sequence[str] = ()) -> Column:
    """Quoted phrases of 4 to 120 characters, paragraph numbers and triggers that a text names, distinct by case."""
    x = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    quoted = F.regexp_extract_all(x, F.lit(r'["“]([^"”]{4,120})["”]'), 1)
    para = F.transform(F.regexp_extract_all(x, F.lit(r"(?i)paragraph (\d{1,4})"), 1), lambda n: F.concat(n, F.lit(".")))
    named = F.array_compact(F.array(*[F.when(F.contains(F.lower(x), F.lit(t.lower())), F.lit(t)) for t in triggers])) if triggers else F.array().cast("array<string>")
    every = F.concat(quoted, para, named)
    return F.transform(F.filter(F.transform(every, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: F.array_position(F.transform(every, lambda u: F.lower(u)), F.lower(s["v"])) == s["i"] + 1), lambda s: s["v"])


def first_fields(df: DataFrame, keep: Sequence[str], page: str, text: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows ``(*keep, field, value, page)``: the first match of each field's rule on the pages that match its cue, in page order, else on any.

    ``rules`` are (field, cue pattern, value pattern with one group).
    """
    t = F.coalesce(text, F.lit(""))
    hits = F.array_compact(F.array(*[F.when(t.rlike(v), F.struct(F.lit(f).alias("field"), F.regexp_extract(t, v, 1).alias("value"), F.when(t.rlike(c), 0).otherwise(1).alias("rank"))) for f, c, v in rules]))
    rows = df.select(*keep, F.col(page).alias("page"), F.explode(hits).alias("_h")).select(*keep, "page", "_h.field", "_h.value", "_h.rank")
    w = Window.partitionBy(*keep, "field").orderBy("rank", "page")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keep, "field", "value", "page")


def named_categories(df: DataFrame, keep: Sequence[str], text: str, rules: Sequence[tuple[str, str]], most: int = 3) -> DataFrame:
    """Rows ``(*keep, category, place)``: categories whose pattern a text matches, by place of the first match, ``most`` at most."""
    low = F.coalesce(text, F.lit(""))
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.regexp_instr(low, F.lit(p)).alias("at"), F.lit(n).alias("category"))) for p, n in rules]))
    near = df.select(*keep, F.posexplode(F.slice(F.sort_array(hits), 1, most)).alias("place", "_h"))
    return near.select(*keep, F.col("_h.category").alias("category"), (F.col("place") + 1).alias("place"))


def flattened_json(df: DataFrame, keep: Sequence[str], payload: str, depth: int = 6) -> DataFrame:
    """Rows ``(*keep, path, value)``: the leaves of a JSON object by dotted path; lists stay JSON (P15). One pass per level; what is still an object after ``depth`` of them is given out as JSON."""
    level = df.select(*keep, F.lit("").alias("path"), F.col(payload).alias("value"))
    out = None
    for n in range(depth):
        is_open = F.coalesce(F.substring(F.ltrim("value"), 1, 1) == "{", F.lit(False))
        done = level.where((F.col("path") != "") & (~is_open if n < depth - 1 else F.lit(True)))
        out = done if out is None else out.unionByName(done)
        if n < depth - 1:
            level = level.where(is_open).select(*keep, "path", F.explode(F.from_json("value", "map<string,string>")).alias("_k", "value")).select(*keep, F.concat(F.when(F.col("path") == "", F.lit("")).otherwise(F.concat("path", F.lit("."))), "_k").alias("path"), "value")
    return out


def pruned_value(value: Column, kind: DataType) -> Column:
    """A value without nulls, blank texts and empty containers, at any depth of its type; null if nothing is left."""
    if isinstance(kind, StringType):
        return F.when(F.trim(value) != "", value)
    if isinstance(kind, StructType):
        parts = [pruned_value(value.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(F.coalesce(*[p.isNotNull() & F.lit(True) for p in [F.coalesce(*[q.cast("string") if not isinstance(f.dataType, (StructType, ArrayType)) else F.to_json(F.struct(q.alias("v"))) if isinstance(f.dataType, ArrayType) else F.to_json(q) for q, f in zip(parts, kind)])]]), F.struct(*parts))
    if isinstance(kind, ArrayType):
        kept = F.filter(F.transform(value, lambda x: pruned_value(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    return value


def pruned(df: DataFrame, columns: Sequence[str]) -> Column:
    """Columns of any type as one JSON object without nulls, blank texts and empty containers at any depth."""
    return F.to_json(F.struct(*[pruned_value(F.col(c), df.schema[c].dataType).alias(c) for c in columns]))


def selected(df: DataFrame, column: str, selection: str, families: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``df`` with ``excluded``: whether a selection such as ``All`` or ``a, b|c`` of names and families leaves a row out."""
    wanted = {w.strip().lower() for w in selection.replace(";", ",").replace("|", ",").split(",") if w.strip()}
    if not wanted or "all" in wanted:
        return df.withColumn("excluded", F.lit(False))
    for f, members in (families or {}).items():
        if f.lower() in wanted:
            wanted |= {m.lower() for m in members}
    return df.withColumn("excluded", ~F.coalesce(F.lower(F.trim(column)).isin(*sorted(wanted)), F.lit(False)))


def island_scores(islands: DataFrame, entries: DataFrame, key: str, label: str, text: str, particulars: str, dates: Callable, cases: Callable) -> DataFrame:
    """Rows ``(key, label, island, score)``: how well an island's text fits an index entry: shared dates 5, case numbers 4, words of six letters 1."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{6,})"), 1))
    tagged = lambda xs, tag, w: F.transform(xs, lambda x: F.struct(F.concat(F.lit(tag), x).alias("f"), F.lit(w).alias("w")))
    features = lambda c: F.explode(F.concat(tagged(dates(c), "d:", 5), tagged(cases(c), "c:", 4), tagged(words(F.col(c)), "w:", 1))).alias("_f")
    a = islands.select(key, "island", features(text)).select(key, "island", "_f.f").distinct()
    b = entries.select(key, label, features(particulars)).select(key, label, "_f.f", "_f.w").distinct()
    # islands and entries meet by what they share, not each with each
    scored = a.join(b, [key, "f"]).groupBy(key, label, "island").agg(F.sum("w").alias("score"))
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy(key, label).orderBy(F.desc("score"), "island"))).where("_r = 1").drop("_r")


def repaired_labels(df: DataFrame, passes: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``df`` after passes in their order: each takes the page map and gives it back."""
    for p in passes:
        df = p(df)
    return df


def bridged(df: DataFrame, filing: str, page: str, label: str, most: int = 2) -> DataFrame:
    """A pass: unlabelled runs of at most ``most`` pages between two pages of one label get it."""
    w = Window.partitionBy(filing).orderBy(page)
    before, after = F.last(F.when(F.col(label).isNotNull(), F.struct(F.col(page).alias("p"), F.col(label).alias("l"))), True), F.first(F.when(F.col(label).isNotNull(), F.struct(F.col(page).alias("p"), F.col(label).alias("l"))), True)
    x = df.withColumn("_b", before.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", after.over(w.rowsBetween(0, Window.unboundedFollowing)))
    fill = F.col(label).isNull() & (F.col("_b.l") == F.col("_a.l")) & (F.col("_a.p") - F.col("_b.p") - 1 <= most)
    return x.withColumn(label, F.when(fill, F.col("_b.l")).otherwise(F.col(label))).drop("_b", "_a")


def smoothed(df: DataFrame, filing: str, page: str, label: str) -> DataFrame:
    """A pass: a single page between two of another label, weakly labelled (``weak``), gets theirs."""
    w = Window.partitionBy(filing).orderBy(page)
    between = F.col("weak") & (F.lag(label).over(w) == F.lead(label).over(w)) & (F.lag(label).over(w) != F.col(label))
    return df.withColumn(label, F.when(F.coalesce(between, F.lit(False)), F.lag(label).over(w)).otherwise(F.col(label)))


def reconciled(df: DataFrame, filing: str, page: str, label: str, proposed: str) -> DataFrame:
    """Proposed labels are taken where a page has none, and by weak pages next to one that has the proposed label or takes it.

    That spreads over any number of pages: a chain of neighbours with one proposal, each without a label or weak,
    takes it if one of them has no label, has it already, or stands next to a page that has it. So windows alone do it.
    """
    w = Window.partitionBy(filing).orderBy(page)
    may = F.col(proposed).isNotNull() & (F.col(label).isNull() | F.coalesce("weak", F.lit(False)))
    x = df.withColumn("_may", may)
    goes_on = F.coalesce(F.col("_may") & F.lag("_may").over(w) & (F.lag(proposed).over(w) == F.col(proposed)), F.lit(False))
    seed = F.col("_may") & (F.col(label).isNull() | (F.col(label) == F.col(proposed)) | F.coalesce(F.lag(label).over(w) == F.col(proposed), F.lit(False)) | F.coalesce(F.lead(label).over(w) == F.col(proposed), F.lit(False)))
    x = x.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_seed", seed).withColumn("_chain", F.sum("_new").over(w))
    take = F.col("_may") & F.max("_seed").over(Window.partitionBy(filing, "_chain"))
    return x.withColumn(label, F.when(take, F.col(proposed)).otherwise(F.col(label))).select(*df.columns)


def source_transitions(df: DataFrame, filing: str, page: str, header: str) -> DataFrame:
    """Rows ``(filing, page, before, after)``: pages from which on two pages share a case header, after two that share another."""
    w = Window.partitionBy(filing).orderBy(page)
    x = df.select(filing, F.col(page).alias("page"), F.col(header).alias("_h")).withColumn("before", F.lag("_h", 1).over(Window.partitionBy(filing).orderBy("page"))).withColumn("_b2", F.lag("_h", 2).over(Window.partitionBy(filing).orderBy("page"))).withColumn("_n", F.lead("_h", 1).over(Window.partitionBy(filing).orderBy("page")))
    return x.where("before = _b2 and _h = _n and before <> _h").select(filing, "page", "before", F.col("_h").alias("after"))


def selected_pages(df: DataFrame, document: str, page: str, selector: str, cue: Column | None = None) -> DataFrame:
    """Rows of a document's pages that a selector takes, with ``priority``: all, first, last, first_last, all_short or cues."""
    w = Window.partitionBy(document)
    n, a, b = F.count("*").over(w), F.row_number().over(w.orderBy(page)), F.row_number().over(w.orderBy(F.desc(page)))
    x = df.withColumn("_n", n).withColumn("_a", a).withColumn("_b", b)
    take = {"all": F.lit(True), "first": F.col("_a") == 1, "last": F.col("_b") == 1, "first_last": (F.col("_a") == 1) | (F.col("_b") == 1), "all_short": F.col("_n") <= 3}
    if selector == "cues":
        x = x.where(cue).withColumn("_b", F.row_number().over(w.orderBy(F.desc(page))))
        return x.where("_b <= 2").withColumn("priority", F.lit(90)).drop("_n", "_a", "_b")
    return x.where(take[selector]).withColumn("priority", F.when(F.col("_a") == 1, 100).otherwise(80)).drop("_n", "_a", "_b")


def marks_for_needs(marks: DataFrame, needs: DataFrame, kind: str, page_labels: DataFrame, filing: str) -> DataFrame:
    """Rows of marks that meet a need: the same kind, and the need's label on the mark's page."""
    return marks.join(needs.select(kind, F.col("label")).distinct(), kind).join(page_labels.select(filing, "page", "label").distinct(), [filing, "page", "label"])


def required_slots(parts: DataFrame, filing: str, slot: str, required: DataFrame) -> DataFrame:
    """Rows ``(filing, slot)``: required slots (one column ``slot``) that a filing's upload lacks."""
    want = parts.select(filing).distinct().withColumn("_s", required.select(F.collect_set("slot")).scalar())
    return want.select(filing, F.explode("_s").alias(slot)).join(parts.select(filing, slot).distinct(), [filing, slot], "left_anti")


def anchored(df: DataFrame, filing: str, page: str, label: str, opens: Column) -> DataFrame:
    """A pass: a label starts only where a page opens it; other pages go on with the last that did."""
    w = Window.partitionBy(filing).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(label, F.coalesce(F.last(F.when(opens, F.col(label)), True).over(w), F.col(label)))


def absorbed(df: DataFrame, filing: str, page: str, label: str, most: int = 1) -> DataFrame:
    """A pass: a run of at most ``most`` pages between two runs of one label joins them."""
    w = Window.partitionBy(filing).orderBy(page)
    cut = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    x = df.withColumn("_c", cut).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(filing).orderBy("_run")
    runs = x.groupBy(filing, "_run").agg(F.count("*").alias("_n"), F.first(label).alias("_l")).withColumn("_p", F.lag("_l").over(v)).withColumn("_q", F.lead("_l").over(v))
    take = runs.where((F.col("_n") <= most) & (F.col("_p") == F.col("_q"))).select(filing, "_run", "_p")
    return x.join(take, [filing, "_run"], "left").withColumn(label, F.coalesce("_p", label)).select(*df.columns)


def rising_numbers(df: DataFrame, filing: str, page: str, label: str, number: Column) -> DataFrame:
    """A pass: a numbered label that falls behind the highest so far is read as that one."""
    w = Window.partitionBy(filing).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.when(number.isNotNull(), F.struct(number.alias("n"), F.col(label).alias("l")))).over(w)
    return df.withColumn(label, F.when(number.isNotNull(), top["l"]).otherwise(F.col(label)))


def bracketed(df: DataFrame, filing: str, page: str, label: str, entries: DataFrame) -> DataFrame:
    """A pass: weak or unlabelled pages take the label of the index entry whose range they stand in (G4): from its start to the next entry's.

    ``entries`` has ``filing, start, part``; of entries with one start the first by name holds. The last start up to a page is found by one window
    over pages and starts together, not by a range join.
    """
    first = entries.groupBy(filing, F.col("start").alias(page)).agg(F.min("part").alias("_part"))
    marks = df.select(*df.columns, F.lit(None).cast("string").alias("_part"), F.lit(1).alias("_o")).unionByName(first.withColumn("_o", F.lit(0)), allowMissingColumns=True)
    held = F.last("_part", True).over(Window.partitionBy(filing).orderBy(page, "_o").rowsBetween(Window.unboundedPreceding, 0))
    x = marks.withColumn("_held", held).where("_o = 1")
    take = F.col("_held").isNotNull() & (F.col(label).isNull() | F.coalesce("weak", F.lit(False)))
    return x.withColumn(label, F.when(take, F.col("_held")).otherwise(F.col(label))).select(*df.columns)


def reopened(df: DataFrame, filing: str, page: str, label: str, heading: str) -> DataFrame:
    """A pass: a page whose heading names another label opens it, and the unlabelled or weak pages behind go on with it up to the next heading or firm page."""
    w = Window.partitionBy(filing).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    firm = F.col(label).isNotNull() & ~F.coalesce("weak", F.lit(False))
    word = F.when(F.col(heading).isNotNull(), F.struct(F.lit(True).alias("h"), F.col(heading).alias("l"))).when(firm, F.struct(F.lit(False).alias("h"), F.col(label).alias("l")))
    x = df.withColumn("_last", F.last(word, True).over(w))
    take = F.col(heading).isNotNull() | F.coalesce(F.col("_last.h"), F.lit(False))
    return x.withColumn(label, F.when(take, F.col("_last.l")).otherwise(F.col(label))).select(*df.columns)


def sole_runs(df: DataFrame, filing: str, page: str, label: str, least: int = 2) -> DataFrame:
    """A pass: of a label with several runs, runs of fewer than ``least`` pages lose it (G4); a label whose runs are all short keeps its first."""
    rows = df.where(F.col(label).isNotNull()).select(filing, page, F.col(label).alias("_l")).distinct()
    run = rows.withColumn("_run", F.col(page) - F.row_number().over(Window.partitionBy(filing, "_l").orderBy(page)))
    runs = run.groupBy(filing, "_l", "_run").agg(F.count("*").alias("_n"), F.min(page).alias("_s"))
    v = Window.partitionBy(filing, "_l")
    gone = runs.withColumn("_most", F.max("_n").over(v)).withColumn("_k", F.row_number().over(v.orderBy("_s"))).where((F.col("_n") < least) & ~((F.col("_most") < least) & (F.col("_k") == 1)))
    lost = run.join(gone.select(filing, "_l", "_run"), [filing, "_l", "_run"], "left_semi").select(F.col(filing).alias("_f"), F.col(page).alias("_p"), F.col("_l").alias("_lost"))
    x = df.join(lost, F.col(filing).eqNullSafe(F.col("_f")) & (F.col(page) == F.col("_p")) & (F.col(label) == F.col("_lost")), "left")
    return x.withColumn(label, F.when(F.col("_lost").isNull(), F.col(label))).select(*df.columns)


def word_table(words: DataFrame, keys: Sequence[str], starts: Sequence[float], tolerance: float = 0.01) -> DataFrame:
    """Rows ``(*keys, row, cells)``: a table rebuilt from its words' places.

    Words whose tops follow each other by less than ``tolerance`` stand in one row; a word belongs to the last column that ``starts``
    left of it or at it (those left of all to the first). Words of a cell read from left to right; empty cells are empty texts.
    """
    w = Window.partitionBy(*keys).orderBy("y", "x", "word")
    lined = words.withColumn("_new", F.coalesce((F.col("y") - F.lag("y").over(w) >= tolerance).cast("int"), F.lit(1))).withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    column = sum(((F.col("x") >= s).cast("int") for s in starts[1:]), F.lit(0))
    cells = lined.withColumn("_c", column).groupBy(*keys, "row", "_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word"))), lambda v: v["word"]), " ").alias("_t"))
    per = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_t"))).alias("_m"))
    return per.select(*keys, F.col("row").cast("bigint").alias("row"), F.array(*[F.coalesce(F.try_element_at("_m", F.lit(i)), F.lit("")) for i in range(len(starts))]).alias("cells"))


def quote_boxes(matches: DataFrame, words: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """Rows ``(ident, *keys, line, x, y, w, h)``: the boxes of a quote's words, one per line (Q2).

    ``matches`` has ``ident, keys, first, last``, places of words; ``words`` ``keys, place, line, x, y, w, h``.
    """
    m = matches.select(ident, *keys, "first", "last").distinct()
    hit = m.join(words, list(keys)).where(F.col("place").between(F.col("first"), F.col("last")))
    box = hit.groupBy(ident, *keys, "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"))
    return box.select(ident, *keys, "line", "x", "y", F.bround(F.col("_r") - F.col("x"), 6).alias("w"), F.bround(F.col("_b") - F.col("y"), 6).alias("h"))


def description_sources(wanted: DataFrame, chunks: DataFrame, filing: str, label: str, *, own: int = 3) -> DataFrame:
    """Rows ``(filing, label, place, record_id, source)``: what a label's description is drawn from (N5): the first chunk of a synopsis that names it, then its ``own`` first chunks.

    ``chunks`` has ``filing, record_id, part, page, text``, the part being the label itself for its own chunks.
    """
    both = wanted.select(filing, label).distinct().join(chunks, filing)
    named = both.where((F.col("part") == "synopsis") & F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(label))).withColumn("source", F.lit("synopsis")).withColumn("_most", F.lit(1))
    mine = both.where(F.col("part") == F.col(label)).withColumn("source", F.lit("own")).withColumn("_most", F.lit(own))
    rows = named.unionByName(mine).withColumn("_k", F.row_number().over(Window.partitionBy(filing, label, "source").orderBy(F.asc_nulls_last("page"), "record_id"))).where("_k <= _most")
    return rows.select(filing, label, F.row_number().over(Window.partitionBy(filing, label).orderBy(F.desc("source"), "_k")).alias("place"), "record_id", "source")
