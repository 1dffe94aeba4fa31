"""Records as JSON or structs: paths, slices, codes with fallbacks, status lines, remaps of layouts, rows of tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_at(record: str | Column, path: str) -> Column:
    """The value at ``a.b.c`` of a JSON text; null if any part is missing."""
    keys = "".join(f"['{k}']" for k in path.split("."))
    return F.get_json_object(F.col(record) if isinstance(record, str) else record, f"${keys}")


def sliced_record(record: str | Column, allowed: Column) -> Column:
    """The top-level entries of a JSON record whose keys are in the array ``allowed``, as a map of texts (P17); null without an array."""
    entries = F.from_json(F.col(record) if isinstance(record, str) else record, "map<string,string>")
    return F.map_filter(entries, lambda k, _: F.array_contains(allowed, k))


def first_code(*candidates: Column) -> Column:
    """The first candidate that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates])


def plain_status(*candidates: Column) -> Column:
    """The first status that isn't null or blank: lower case, one underscore for blanks and hyphens."""
    return F.regexp_replace(F.lower(first_code(*candidates)), r"[\s-]+", "_")


def label_order(label: str | Column) -> list[Column]:
    """Sort keys of labels such as "Annexure P-3": series P, then R, then others, by number; what isn't such a label last."""
    c = F.trim(F.col(label) if isinstance(label, str) else label)
    pattern = r"(?i)^annexure\s+([a-z])-?(\d+)$"
    series = F.upper(F.regexp_extract(c, pattern, 1))
    fits = F.coalesce(c.rlike(pattern), F.lit(False))
    return [F.when(fits, F.when(series == "P", 0).when(series == "R", 1).otherwise(2)).otherwise(99), F.when(fits, F.regexp_extract(c, pattern, 2).cast("int")).otherwise(9999)]


def usage_line(amount: Column, pending: Column, cost: Column, detail: Column) -> Column:
    """A summary's line for people: amount, cost and detail, or how many jobs aren't billed yet."""
    money = F.coalesce(F.concat(F.lit(" (~$"), F.format_string("%.4f", cost), F.lit(")")), F.lit(""))
    more = F.when(F.coalesce(F.trim(detail), F.lit("")) != "", F.concat(F.lit(" ["), F.trim(detail), F.lit("]"))).otherwise(F.lit(""))
    return F.when(amount.isNull(), F.concat(F.lit("usage pending ("), F.coalesce(pending, F.lit(0)).cast("string"), F.lit(" job(s) not billed yet)"))).otherwise(F.concat(amount.cast("string"), F.lit(" credits"), money, more))


def resolved(valid: Sequence[str], *candidates: Column) -> Column:
    """The first candidate that is one of the ``valid`` names."""
    return F.coalesce(*[F.when(c.isin(list(valid)), c) for c in candidates])


def slot_of(explicit: Column, stem: Column, mapping: dict[str, str], default: str) -> Column:
    """A file's slot: the one given, else that of its stem (numbered stems keep their number), else the default."""
    base = F.lower(F.regexp_replace(F.trim(stem), r"[\s-]+", "_"))
    name, number = F.regexp_extract(base, r"^(.*?)_?\d*$", 1), F.regexp_extract(base, r"_?(\d+)$", 1)
    known = F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")
    family = F.try_element_at(known, name)
    numbered = F.when(family.isNotNull() & (number != ""), F.concat(family, F.lit("_"), F.regexp_replace(number, r"^0+(?=\d)", "")))
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.try_element_at(known, base), numbered, family, F.lit(default))


def eligible_pages(df: DataFrame, key: str, page: str, eligible: Column) -> DataFrame:
    """Rows ``(key, pages)``: how many distinct pages may count, 0 for keys without any."""
    return df.groupBy(key).agg(F.count_distinct(F.when(eligible, F.col(page))).alias("pages"))


def of_check(index: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The entries of an index on pages that belong to the check."""
    return index.join(pages.select(*keys).distinct(), list(keys), "left_semi")


def in_scope(df: DataFrame, scope: dict[str, Column | str]) -> DataFrame:
    """The rows of one tenant: each scope column equal to its value, null to nothing."""
    for name, value in scope.items():
        df = df.where(F.col(name) == value)
    return df


def stitched_words(words: DataFrame, parts: DataFrame, keys: Sequence[str], part: str, page: str, order: str, count: str) -> DataFrame:
    """``words`` with ``stitched_page``: a part's local page moved behind the pages of the parts before it.

    ``parts`` has ``keys, part``, its order and its number of pages. Words outside their part's pages, and parts that aren't stitched, have no row.
    """
    w = Window.partitionBy(*keys).orderBy(order, part).rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select(*keys, part, F.col(count).alias("_n"), F.coalesce(F.sum(count).over(w), F.lit(0)).alias("_before"))
    joined = words.join(offset, [*keys, part]).where(F.col(page).between(1, F.col("_n")))
    return joined.withColumn("stitched_page", F.col(page) + F.col("_before")).drop("_n", "_before")


def merged_words(better: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words of both layers: on a page that has words of the better one, only these."""
    return better.unionByName(other.join(better.select(*keys).distinct(), list(keys), "left_anti"))


def quote_rows(text: str | Column, labels: Sequence[str] = ()) -> Column:
    """A table's text as rows of cells: ``|`` or tabs part cells, ``label: value`` cells lose labels that are known; rows without two cells are none."""
    t = F.col(text) if isinstance(text, str) else text
    names = "|".join(x.replace(".", r"\.") for x in labels)
    cell = lambda c: F.regexp_replace(F.trim(c), rf"^(?:{names})\s*:\s*", "") if names else F.trim(c)
    rows = F.transform(F.split(t, "\n"), lambda r: F.filter(F.transform(F.split(r, r"\s*[|\t]\s*"), cell), lambda c: c != ""))
    return F.filter(rows, lambda r: (F.size(r) > 1) & ~F.forall(r, lambda c: c.rlike(r"^[-=\s:]+$")))


def best_images(candidates: DataFrame, check: str, page: str, priority: str, most: int = 4) -> DataFrame:
    """``candidates`` with ``place`` and ``kept``: each check's pages by priority (a page proposed twice by its highest), ``most`` kept, the others told."""
    one = candidates.groupBy(check, page).agg(F.max(priority).alias(priority))
    place = F.row_number().over(Window.partitionBy(check).orderBy(F.desc(priority), page))
    return one.withColumn("place", place).withColumn("kept", F.col("place") <= most)


def switched(pointers: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Rows ``(key, generation, dropped, stale)``: after a run the new generation if it succeeded, else the old one, and which is to go.

    ``pointers`` has ``key, generation``, ``results`` ``key, generation, succeeded``; reports of a replaced generation are stale.
    """
    r = results.select(key, F.col("generation").alias("_new"), F.coalesce("succeeded", F.lit(False)).alias("_ok"))
    both = pointers.select(key, F.col("generation").alias("_old")).join(r, key, "full_outer")
    ok = F.coalesce("_ok", F.lit(False))
    return both.select(key, F.when(ok, F.col("_new")).otherwise(F.col("_old")).alias("generation"), F.when(ok, F.col("_old")).otherwise(F.col("_new")).alias("dropped"), (ok & F.col("_old").isNotNull()).alias("stale"))


def parsed_marks(df: DataFrame, keep: Sequence[str], content: str) -> DataFrame:
    """Rows ``(*keep, kind, role, x, y, w, h)``: marks a model found on a page, from its JSON answer.

    The answer is an array of objects, or an object with the array under ``marks``, fenced as code or not. Marks without a kind
    or whose box isn't inside 0..1 are left out; what isn't JSON gives none.
    """
    kind = "array<struct<type:string,role:string,x:double,y:double,w:double,h:double>>"
    plain = F.regexp_replace(F.trim(content), r"^```(?:json)?\s*|\s*```$", "")
    found = F.coalesce(F.from_json(F.get_json_object(plain, "$.marks"), kind), F.from_json(F.when(plain.startswith("["), plain), kind))
    m = df.select(*keep, F.explode(found).alias("_m"))
    box = F.col("_m.x").between(0, 1) & F.col("_m.y").between(0, 1) & (F.col("_m.w") > 0) & (F.col("_m.h") > 0) & (F.col("_m.x") + F.col("_m.w") <= 1) & (F.col("_m.y") + F.col("_m.h") <= 1)
    return m.where((F.trim("_m.type") != "") & box).select(*keep, F.lower(F.trim("_m.type")).alias("kind"), F.coalesce(F.nullif(F.lower(F.trim("_m.role")), F.lit("")), F.lit("unknown")).alias("role"), *[F.col(f"_m.{c}").alias(c) for c in "xywh"])


def local_pages(findings: DataFrame, layout: DataFrame, ident: str, keys: Sequence[str], pages: str, slot: str) -> DataFrame:
    """Rows ``(ident, slot, pages)``: a finding's pages as the pages of the documents that hold them, in order.

    ``layout`` has ``keys, slot, page, local_page``; pages no document holds are left out.
    """
    asked = findings.select(ident, *keys, F.explode(pages).alias("page")).distinct()
    return asked.join(layout.select(*keys, slot, "page", "local_page").distinct(), [*keys, "page"]).groupBy(ident, slot).agg(F.array_sort(F.collect_set("local_page")).alias("pages"))


def key_fields(df: DataFrame, ident: str, record: str, paths: dict[str, Sequence[str]]) -> DataFrame:
    """Rows ``(ident, field, value, source)``: for each field the value at the first of its paths that has one, null if none has."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    found = lambda ps: (F.coalesce(*[blank(value_at(record, p)) for p in ps]), F.coalesce(*[F.when(blank(value_at(record, p)).isNotNull(), F.lit(p)) for p in ps]))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), s.alias("source")) for f, ps in paths.items() for v, s in [found(ps)]])
    return df.select(ident, F.explode(rows).alias("_r")).select(ident, "_r.field", "_r.value", "_r.source")


def needs_of(df: DataFrame, ident: str, text: str, parts: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows ``(ident, need, part)``: what a check needs to be seen (R47): a need whose pattern its text holds, on the rule's part, or on each of the check's own.

    ``rules`` are (need, pattern, part); a rule without a part takes the check's parts, and null where it has none.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.lit(n).alias("need"), F.lit(part or None).cast("string").alias("part"))) for n, p, part in rules]))
    own = F.when(F.size(F.coalesce(parts, F.array().cast("array<string>"))) > 0, F.col(parts)).otherwise(F.array(F.lit(None).cast("string")))
    one = df.select(ident, own.alias("_own"), F.explode(hits).alias("_h"))
    return one.select(ident, F.col("_h.need").alias("need"), F.explode(F.when(F.col("_h.part").isNull(), F.col("_own")).otherwise(F.array("_h.part"))).alias("part")).distinct()


def restored(df: DataFrame, column: str) -> Column:
    """A column written as JSON and read again by its own type (R48, K5): equal to what it was, but for null fields that are left out."""
    return F.from_json(F.to_json(column), df.schema[column].dataType.simpleString())


def first_existing_id(candidates: DataFrame, existing: DataFrame, key: str, ident: str, priority: str) -> DataFrame:
    """Rows ``(key, ident)``: of a key's candidates the first by ``priority`` that exists (R15); keys without one have no row."""
    there = candidates.join(existing.select(ident).distinct(), ident, "left_semi")
    return there.groupBy(key).agg(F.min(F.struct(F.col(priority).alias("p"), F.col(ident).alias("i")))["i"].alias(ident))


def enveloped(df: DataFrame, keep: Sequence[str], fields: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """``df`` with each field as ``struct(value, confidence, pages)`` (N4): the confidence within 0..1 or null, the pages sorted and each once; null values have no envelope."""
    wrap = lambda v, c, p: F.when(v.isNotNull(), F.struct(v.alias("value"), F.when(c.between(0, 1), c).alias("confidence"), F.array_sort(F.array_distinct(F.array_compact(F.coalesce(p, F.array().cast("array<int>"))))).alias("pages")))
    return df.select(*keep, *[wrap(*x).alias(name) for name, x in fields.items()])


def severity_counts(flags: DataFrame, keys: Sequence[str], severities: Sequence[str]) -> DataFrame:
    """Per key how many flags of each severity there are, of any, and whether none is an error."""
    return flags.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in severities], F.count("*").alias("flags"), (F.count_if(F.col("severity") == "error") == 0).alias("passed"))
