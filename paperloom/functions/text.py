"""Column functions over text: cleaning, folding, dates, case numbers, annexure marks, names, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(c: str | Column) -> Column:
    """Lower case, white space single and trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


#: Named entities that are resolved (fixed values).
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def clean_markup(c: str | Column) -> Column:
    """Text without tags and marks: breaks become line ends, entities characters, blanks single, at most one empty line (F1)."""
    x = F.regexp_replace(col(c), r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"<[A-Za-z/][^>]*>", "")
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"(?m)^#{1,6} +", "")
    x = F.regexp_replace(x, r"\*\*|__", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def quote_fold(c: str | Column) -> Column:
    """A key for matching quotes: lower case, dashes and quotes plain, markup and links gone, other marks blanks (F2)."""
    x = F.translate(F.lower(col(c)), "‘’“”–—", "''\"\"--")
    x = F.regexp_replace(x, r"<[a-z/][^>]*>", " ")
    x = F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"\.\.\.|…", " ellipsis ")
    return F.trim(F.regexp_replace(x, r"[^a-z0-9/]+", " "))


def canonical_tokens(c: str | Column) -> Column:
    """The tokens of a folded text; ordinals lose their ending."""
    return F.transform(F.split(quote_fold(c), " "), lambda t: F.regexp_replace(t, r"^(\d+)(?:st|nd|rd|th)$", "$1"))


def is_folio_only(c: str | Column, headings: Sequence[str] = ()) -> Column:
    """Whether a text is nothing but a page mark or one of the headings."""
    x = folded(c)
    mark = x.rlike(r"^\W*(?:(?:page|pg|p)\.?\s*(?:no\.?)?\s*)?(?:\d{1,5}|[ivxlc]{1,7})(?:\s*(?:of|/)\s*\d{1,5})?\W*$")
    return F.coalesce(mark | x.isin(*headings) if headings else mark, F.lit(False))


def part_id(c: str | Column) -> Column:
    """A label as identifier: lower case, everything but letters and digits one underscore; ``unknown`` if nothing is left."""
    x = F.btrim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(x == "", F.lit("unknown")).otherwise(x)


def stem(c: str | Column) -> Column:
    """A file name's stem: without folder, ending, copy number and version words."""
    x = F.regexp_replace(F.lower(F.trim(col(c))), r"^.*[/\\]", "")
    x = F.regexp_replace(x, r"\.[a-z0-9]{1,5}$", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"\s*\(\d+\)$|[_ -]+(?:final|copy|v\d+)$", ""), r"[^a-z0-9]+", "_"), F.lit("_"))


def blank_to_null(c: str | Column) -> Column:
    """Null for blanks and placeholders such as n/a, none, null, -."""
    x = F.trim(col(c))
    return F.when(F.lower(x).isin("", "-", "--", "n/a", "na", "none", "null", "nil", "not available", "unknown"), F.lit(None)).otherwise(x)


def first_match(c: str | Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule (pattern, value) that a text matches."""
    out = F.lit(default).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(F.coalesce(col(c), F.lit("")).rlike(pattern), F.lit(value)).otherwise(out)
    return out


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def full_year(y: Column) -> Column:
    """A year of two digits in full: below 50 of this century, else of the last."""
    n = y.try_cast("int")
    return F.when(F.length(y) == 2, F.when(n < 50, n + 2000).otherwise(n + 1900)).otherwise(n)


def date_keys(c: str | Column) -> Column:
    """The dates of a text as sorted distinct ``yyyy-mm-dd``: numeric day first, and with month names."""
    x = F.coalesce(col(c), F.lit(""))
    number = F.transform(F.regexp_extract_all(x, F.lit(r"(?<![\d./-])(\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2}))(?![\d./-]*\d)"), 1), lambda d: F.split(d, "[./-]"))
    names = "|".join(MONTHS)
    spoken = F.transform(F.regexp_extract_all(F.lower(x), F.lit(rf"(?<!\d)(\d{{1,2}}(?:st|nd|rd|th)?(?: day of)? (?:{names}),? \d{{4}})"), 1), lambda d: F.array(F.regexp_extract(d, r"^(\d+)", 1), F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(d, rf"({names})", 1)).cast("string"), F.regexp_extract(d, r"(\d{4})$", 1)))
    ahead = F.transform(F.regexp_extract_all(F.lower(x), F.lit(rf"((?:{names}) \d{{1,2}}, \d{{4}})"), 1), lambda d: F.array(F.regexp_extract(d, r" (\d+),", 1), F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(d, rf"^({names})", 1)).cast("string"), F.regexp_extract(d, r"(\d{4})$", 1)))
    iso = lambda p: F.format_string("%04d-%02d-%02d", full_year(p[2]), p[1].try_cast("int"), p[0].try_cast("int"))
    valid = lambda p: (p[1].try_cast("int").between(1, 12)) & (p[0].try_cast("int").between(1, 31)) & (full_year(p[2]).between(1900, 2100))
    return F.sort_array(F.array_distinct(F.transform(F.filter(F.concat(number, spoken, ahead), valid), iso)))


def case_numbers(c: str | Column) -> Column:
    """The case numbers of a text, as sorted distinct ``number/year``."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?i)No\.?\s*(\d{1,6}\s*(?:/|of)\s*\d{4})"), 1)
    return F.sort_array(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"\s*(?:/|of)\s*", "/"))))


def annexure_marks(c: str | Column) -> Column:
    """The annexure marks of a text in order: series letter and number, such as ``P-3``."""
    found = F.regexp_extract_all(F.upper(F.coalesce(col(c), F.lit(""))), F.lit(r"ANNEXURES?\s*[-–:]?\s*([A-Z]\s*[-–/]?\s*\d{1,3})"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^([A-Z])\s*[-–/]?\s*0*(\d+)$", "$1-$2")))


def cited_pages(c: str | Column) -> Column:
    """Page ranges that a text cites: ``pages 3 to 9`` as ``3-9``."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"(?:pages?|pp?\.)\s*(?:nos?\.?\s*)?(\d{1,5}(?:\s*(?:-|–|to)\s*\d{1,5})?)"), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, r"\s*(?:-|–|to)\s*", "-"))


def percent_text(c: str | Column) -> Column:
    """A confidence as ``91%``: fractions up to 1, percents, and texts of either; null otherwise."""
    x = F.regexp_replace(F.trim(col(c).cast("string")), r"\s*%$", "").try_cast("double")
    per = F.when(col(c).cast("string").contains("%"), x).when(x <= 1, x * 100).otherwise(x)
    return F.when((per >= 0) & (per <= 100), F.concat(F.bround(per, 0).cast("int").cast("string"), F.lit("%")))


def duration_text(seconds: str | Column) -> Column:
    """Seconds as ``1h 2m 3s``, ``2m 3s`` or ``3.4s``."""
    s = col(seconds)
    w = F.floor(s)
    return F.when(s < 60, F.concat(F.round(s, 1).cast("string"), F.lit("s"))).when(s < 3600, F.format_string("%dm %ds", F.floor(w / 60), w % 60)).otherwise(F.format_string("%dh %dm %ds", F.floor(w / 3600), F.floor(w % 3600 / 60), w % 60))


def safe_url(url: str | Column) -> Column:
    """A URL without user, query and fragment; null if it has no host."""
    u = col(url)
    host = F.try_parse_url(u, F.lit("HOST"))
    return F.when(host.isNotNull(), F.concat(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("://"), host, F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))))


def scoped_id(*parts: str | Column) -> Column:
    """sha-256 of the parts joined by the unit separator; null if one is null."""
    every = [col(p).cast("string") for p in parts]
    known = every[0].isNotNull()
    for p in every[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.sha2(F.concat_ws("\u001f", *every), 256))


def snippet(c: str | Column, term: str | Column, reach: int = 60) -> Column:
    """The text around the first place of a term, case aside; null without one."""
    t = col(term) if isinstance(term, Column) else F.lit(term)
    at = F.instr(F.lower(col(c)), F.lower(t))
    return F.when(at > 0, F.substring(col(c), F.greatest(at - reach, F.lit(1)), F.length(t) + F.least(at - 1, F.lit(reach)) + reach))


def unit_box(x: Column, y: Column, w: Column, h: Column, least: float = 0.002) -> Column:
    """A box cut to 0..1; null if a side is null, inverted or smaller than ``least``."""
    cut = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    x0, y0, x1, y1 = cut(x), cut(y), cut(x + w), cut(y + h)
    ok = (w > 0) & (h > 0) & (x1 - x0 >= least) & (y1 - y0 >= least)
    return F.when(ok, F.struct(F.bround(x0, 6).alias("x"), F.bround(y0, 6).alias("y"), F.bround(x1 - x0, 6).alias("w"), F.bround(y1 - y0, 6).alias("h")))


def distinct_labels(labels: str | Column) -> Column:
    """The labels without blanks and repeats, order kept."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def expanded_labels(labels: str | Column, families: dict[str, Sequence[str]]) -> Column:
    """The labels, each followed by its family's members."""
    pairs = F.create_map(*[y for k, v in families.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: F.concat(F.array(x), F.coalesce(F.try_element_at(pairs, x), F.array().cast("array<string>"))))))


def text_list(c: str | Column) -> Column:
    """A JSON list of texts, or one plain text, as an array; null as an empty one."""
    x = col(c)
    return F.when(x.isNull() | (F.trim(x) == ""), F.array().cast("array<string>")).when(F.trim(x).startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(x))


def json_or_empty(c: str | Column) -> Column:
    """A JSON object as a map of texts; an empty map for anything else."""
    return F.coalesce(F.from_json(col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def closed_json(c: str | Column) -> Column:
    """A cut-off JSON text with its open text, lists and objects closed, a hanging comma or colon dropped.

    A fold over the characters keeps the stack of open brackets and whether a text is open.
    """
    x = F.coalesce(col(c), F.lit(""))
    start = F.struct(F.lit("").alias("stack"), F.lit(False).alias("text"), F.lit(False).alias("escape"))

    def step(a: Column, ch: Column) -> Column:
        text = F.when(a["text"], ~((ch == '"') & ~a["escape"])).otherwise(ch == '"')
        escape = a["text"] & (ch == "\\") & ~a["escape"]
        stack = F.when(a["text"], a["stack"]).when(ch == "{", F.concat(F.lit("}"), a["stack"])).when(ch == "[", F.concat(F.lit("]"), a["stack"])).when(ch.isin("}", "]"), F.substring(a["stack"], 2, 100000)).otherwise(a["stack"])
        return F.struct(stack.alias("stack"), text.alias("text"), escape.alias("escape"))

    end = F.aggregate(F.split(x, ""), start, step)
    kept = F.when(end["text"], F.concat(x, F.lit('"'))).otherwise(F.regexp_replace(x, r"[,:\s]+$", ""))
    return F.concat(kept, end["stack"])


ORGANISATION = r"(?i)\b(?:ltd|limited|llp|pvt|private|company|corporation|corpn|bank|society|trust|union|state|government|govt|authority|board|council|commission|department|ministry|university|association|enterprises|industries|municipal)\b|^m/s"
HONORIFIC = r"(?i)^(?:(?:mr|mrs|ms|dr|shri|smt|sh|kum|sri|prof|miss|m/s)\.?\s+)+"
ROLE = r"(?i)\s*[\(\[,]?\s*(?:petitioner|respondent|appellant|applicant|complainant|advocate|adv|aor)s?(?:\s*no\.?\s*\d+)?\s*[\)\]]?\.?$"


def is_organisation(c: str | Column) -> Column:
    """Whether a name is a body's."""
    return F.coalesce(col(c).rlike(ORGANISATION), F.lit(False))


def plain_name(c: str | Column) -> Column:
    """A name without honorifics before and role behind, white space single."""
    x = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, HONORIFIC, ""), ROLE, ""))


def party_kind(kind: str | Column, name: str | Column) -> Column:
    """``INDIVIDUAL`` or ``ORGANIZATION``: as noted in whatever spelling, else by the name."""
    k = F.upper(F.trim(col(kind)))
    return F.when(k.startswith("ORG"), "ORGANIZATION").when(k.startswith("IND"), "INDIVIDUAL").when(col(name).isNull(), F.lit(None)).when(is_organisation(name), "ORGANIZATION").otherwise("INDIVIDUAL")


def side_title(main: str | Column, count: str | Column) -> Column:
    """A side of a case title: the main name, with ``and Anr.`` for two parties and ``and Ors.`` for more."""
    m = blank_to_null(main)
    return F.when(m.isNull(), F.lit(None)).when(col(count) == 2, F.concat(m, F.lit(" and Anr."))).when(col(count) > 2, F.concat(m, F.lit(" and Ors."))).otherwise(m)


def within_edits(a: str | Column, b: str | Column, limit: int) -> Column:
    """Whether two texts are at most ``limit`` edits apart."""
    return F.coalesce(F.levenshtein(col(a), col(b), limit) >= 0, F.lit(False))


def similarity(a: str | Column, b: str | Column) -> Column:
    """1 minus edits over the longer length: how alike two spellings are (F8)."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(col(a), col(b)) / longest)


def byte_slice(c: str | Column, start: str | Column, length: str | Column) -> Column:
    """Characters of a text by UTF-8 byte offset (from 0) and length."""
    return F.decode(F.substring(F.encode(col(c), "UTF-8"), col(start) + 1, col(length)), "UTF-8")


def hmac_sha256(message: str | Column, key: bytes) -> Column:
    """The HMAC of a text under a key, in hex: what a receiver checks a callback by (K8)."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda n: F.unhex(F.lit(bytes(b ^ n for b in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(col(message), "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def cited(c: str | Column, sources: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The sources whose id or one of whose other names a text names, in the order of the sources."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    hit = lambda names: F.array_max(F.array(*[F.contains(low, F.lit(n.lower())) for n in names]))
    return F.array_compact(F.array(*[F.when(hit([ident, *names]), F.lit(ident)) for ident, names in sources]))
