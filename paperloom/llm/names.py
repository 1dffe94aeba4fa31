"""Linking of the spellings of one person's or body's name.

Candidates come from a symmetric-delete index over pairs of tokens: a person's name has an
entry for each way to leave a letter out of the family name, combined with each way to leave
one out of the given name (in either order; sounds spelled alike are one more way), so names
share an entry only if both tokens are a slip apart at most. Initials and short forms
stand in entries of their own, where they meet full names, but full names don't meet each
other. A body has entries by each rarer word less a letter, its count of words and the initials
of the others. Only 64-bit numbers travel. No entry grows with the names of one family,
or with those that share a common token alone.

A comparison aligns the tokens of both names by optimal assignment, with one slip
(insertion, omission, exchange or swap) per token, initials, short forms and written-out
abbreviations permitted. It is certain (level 0), or leaves something open: the initial of a middle
name (1), a middle name on one side only (2), a short form (3), an initial (4). Certain links make
components. Then, level by level, a component is linked by open links only if they lead
to a single other component; a spelling that fits two different persons stays apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, spread

#: How names abbreviate words of bodies (fixed values).
ABBREVIATIONS = {"pvt": "private", "p": "private", "ltd": "limited", "corpn": "corporation", "corp": "corporation", "assn": "association", "engg": "engineering", "mfg": "manufacturing", "edu": "educational", "labs": "laboratories", "co": "company", "devp": "developers", "dev": "development", "indl": "industrial", "govt": "government", "coop": "cooperative", "intl": "international", "soc": "society", "bros": "brothers", "ents": "enterprises", "inds": "industries", "fin": "finance", "chem": "chemicals", "fert": "fertilisers", "entps": "enterprises", "co-op": "cooperative", "constr": "construction", "const": "construction", "transp": "transport", "intnl": "international"}
#: Abbreviations of several words, and what stands for a body beside its name (fixed values).
SPELT_OUT = {"idc": ("industrial", "development", "corporation")}
OFFICES = {"municipal": {"commissioner"}}
LEGAL = {"private", "limited", "llp", "association"}
PUBLIC = {"state": "government", "union": "government", "government": "government"}
BODY = LEGAL | {"construction", "cooperative", "government", "corporation", "company", "bank", "mills", "trust", "works", "enterprises", "industries", "factory", "foods", "society", "exports", "laboratories", "developers", "fertilisers", "manufacturing", "resorts", "leasing", "transmission", "brothers", "industrial", "municipal", "board", "authority", "university", "department", "council", "institute", "mining", "cement", "pharma", "steel", "textile", "sugar", "agro"}
HONORIFICS = {"dr", "shri", "sh", "smt", "mr", "mrs", "ms", "kum", "km", "sri", "miss", "prof", "adv", "advocate"}
FILLERS = {"the", "of", "and", "m/s", "messrs"}
ROLE = re.compile(r"[,\s]*[\(\[]?\b(?:aor|adv|advocate(?:[ -]on[ -]record)?|sr\.? adv|senior advocate)\.?[\)\]]?\s*$", re.I)
VERSUS = re.compile(r"(?<=\s)(?:v\.|vs\.?|VS\.?|Vs\.?|v/s|V/s|Versus|VERSUS|versus)(?=\s)")
OTHERS = r"[\s,]*(?:&|\b(?i:and))\s+(?i:another|others?|anr\.?|ors\.?)\s*$"


@lru_cache(maxsize=200_000)
def sound(token: str) -> str:
    """A token with sounds that are spelled in several ways spelled in one."""
    for a, b in (("ee", "i"), ("oo", "u"), ("aa", "a"), ("ph", "f"), ("w", "v"), ("y", "i"), ("ck", "k"), ("q", "k"), ("z", "s")):
        token = token.replace(a, b)
    return token


@lru_cache(maxsize=200_000)
def near(a: str, b: str) -> int:
    """0 for equal tokens, 1 for one slip (a letter more, less, another, or two swapped) or another spelling of a sound, else 2."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if min(la, lb) < 4:
        return 2
    if sound(a) == sound(b):
        return 1
    if abs(la - lb) > 1:
        return 2
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    if la == lb:
        return 1 if a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2
    return 1 if (a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]) else 2


@dataclass(frozen=True)
class Name:
    """A parsed name. A person has ``given``, ``middle``, ``family``; a body has ``words`` and ``legal``."""

    body: bool
    words: tuple[str, ...] = ()
    legal: tuple[str, ...] = ()
    given: str = ""
    middle: tuple[str, ...] = ()
    family: str = ""
    alias: str = ""


class Parser:
    """Parses names; ``common`` are the tokens of many names."""

    def __init__(self, common: frozenset[str], nicknames: dict[str, frozenset[str]]):
        self.common, self.nicknames = common, nicknames
        self.shorts: dict[str, set[str]] = {}
        for s, full in nicknames.items():
            for f in full:
                self.shorts.setdefault(f, set()).add(s)
        by_length: dict[int, list[str]] = {}
        for c in common:
            by_length.setdefault(len(c), []).append(c)
        self.by_length = by_length
        self.parse = lru_cache(maxsize=300_000)(self._parse)
        self.plain = lru_cache(maxsize=300_000)(lambda name: self._parse(name, False))

    def match(self, a: str, b: str) -> tuple[int, int] | None:
        """``compare`` of two names; if that finds nothing, with the last token as the family name of both, common as it may be."""
        x, y = self.parse(a), self.parse(b)
        got = self.compare(x, y)
        if got or x.body or y.body:
            return got
        p, q = self.plain(a), self.plain(b)
        return self.compare(p, q) if (p, q) != (x, y) and p.family == q.family else None

    def usual(self, token: str) -> bool:
        """Whether a token is a common one, with one slip at most."""
        return token in self.common or any(near(token, c) == 1 for n in (-1, 0, 1) for c in self.by_length.get(len(token) + n, ()))

    def _parse(self, name: str, guess: bool = True) -> Name:
        tokens = tokens_of(name)
        if any(map(of_body, tokens)) or re.match(r"\s*(?:m/s|messrs)\b", name, re.I):
            words = [w for t in tokens for w in SPELT_OUT.get(t, (PUBLIC.get(t, t),)) if w not in FILLERS]
            aside = {o for w in words for o in OFFICES.get(w, ())}
            words = [w for w in words if w not in aside]
            legal = []
            while len(words) > 1 and words[-1] in LEGAL:
                legal.insert(0, words.pop())
            return Name(True, words=tuple(words), legal=tuple(legal))
        low = name.lower()
        alias = ""
        if "@" in low:
            low, _, alias = low.partition("@")
            alias = (tokens_of(alias) or [""])[0]
        comma = "," in low
        parts = [[t for t in tokens_of(p) if t not in HONORIFICS or len(tokens_of(p)) == 1] for p in low.split(",")] if comma else []
        parts = [p for p in parts if p]
        if len(parts) == 2:
            family, rest = " ".join(parts[0]), parts[1]
        else:
            t = [x for x in tokens_of(low)]
            while len(t) > 1 and t[0] in HONORIFICS:
                t = t[1:]
            if len(t) < 2:
                return Name(False, family=" ".join(t), alias=alias)
            k = len(t) - 1
            if len(t[k]) == 1 or guess and self.usual(t[k]):
                rare = [i for i, x in enumerate(t) if len(x) > 3 and not self.usual(x)]
                k = rare[0] if rare else k
            family, rest = t[k], t[:k] + t[k + 1 :]
        return Name(False, given=rest[0] if rest else "", middle=tuple(rest[1:]), family=family, alias=alias)

    def short(self, a: str, b: str) -> bool:
        """Whether one given name is a short form of the other."""
        s, f = sorted((a, b), key=len)
        if f in self.nicknames.get(s, ()):
            return True
        if len(s) < 3 or len(f) - len(s) < 1:
            return False
        stem = re.sub(r"(.)\1$", r"\1", s[:-1]) if s[-1] in "uiya" else s
        return f.startswith(s) or len(stem) >= 3 and f.startswith(stem)

    def compare(self, a: Name, b: Name) -> tuple[int, int] | None:
        """``(level, side)`` if both may be one: the open point, and whose side (0: a, 1: b) leaves it open; else None."""
        if a.body != b.body:
            return None
        if a.body:
            if a.legal and b.legal and assign(a.legal, b.legal) is None or assign(a.words, b.words) is None:
                return None
            return (0, 0)
        slips = near(a.family, b.family)
        if slips > 1 and near(a.family, b.given) < 2 and near(a.given, b.family) < 2:
            # the family name stands first, and both names are rare
            b = Name(False, given=b.family, middle=b.middle, family=b.given, alias=b.alias)
            slips = near(a.family, b.family)
        if slips > 1 or not a.given or not b.given:
            return (0, 0) if slips == 0 and a.given == b.given == "" else None
        ga, gb, ma, mb = a.given, b.given, a.middle, b.middle
        # given and middle name written as one word
        if len(ma) > len(mb) and near(ga + "".join(ma), gb) < 2 and len(gb) > len(ga) + 1:
            return (0, 0)
        if len(mb) > len(ma) and near(gb + "".join(mb), ga) < 2 and len(ga) > len(gb) + 1:
            return (0, 0)
        level, side = 0, 0
        g = near(ga, gb)
        if g > 1:
            if len(ga) == 1 or len(gb) == 1:
                if ga[0] != gb[0]:
                    return None
                level, side = 4, int(len(gb) == 1)
            elif a.alias and near(a.alias, gb) < 2 or b.alias and near(b.alias, ga) < 2 or self.short(ga, gb):
                level, side = 3, int(len(gb) < len(ga))
            else:
                return None
        elif slips + g > 2:
            return None
        if ma or mb:
            if len(ma) != len(mb):
                if level < 2:
                    level, side = 2, int(len(mb) < len(ma))
            else:
                pairs = align(ma, mb)
                if pairs is None:
                    return None
                first = next((y for x, y in pairs if near(x, y) > 1), None)
                if first is not None and level < 1:
                    level, side = 1, int(len(first) == 1)
        return (level, side)


def assign(a: tuple[str, ...], b: tuple[str, ...]) -> int | None:
    """The fewest slips of a one-to-one alignment of all tokens of both sides, None if there is none.

    Depth first over the tokens of one side; names have few tokens, and most have one
    partner at most.
    """
    if len(a) != len(b):
        return None
    if sorted(a) == sorted(b):
        return 0
    options = [sorted((near(x, y), j) for j, y in enumerate(b) if near(x, y) < 2 or len(x) > 2 and len(y) > 2 and x[0] == y[0] and (y.startswith(x) or x.startswith(y)) and min(len(x), len(y)) >= 3 and (x in BODY or y in BODY)) for x in a]
    best: list[int | None] = [None]

    def go(i: int, used: int, slips: int) -> None:
        if best[0] is not None and slips >= best[0]:
            return
        if i == len(a):
            best[0] = slips
            return
        for s, j in options[i]:
            if not used >> j & 1:
                go(i + 1, used | 1 << j, slips + s)

    go(0, 0, 0)
    return best[0] if best[0] is not None and best[0] <= 2 else None


def align(a: tuple[str, ...], b: tuple[str, ...]) -> list[tuple[str, str]] | None:
    """The cheapest one-to-one alignment of two persons' middle names, in any order, initials permitted; None if there is none."""
    if len(a) == 1:
        options = [[(0, 0)] if near(a[0], b[0]) < 2 or 1 in (len(a[0]), len(b[0])) and a[0][0] == b[0][0] else []]
    else:
        options = [sorted((near(x, y), j) for j, y in enumerate(b) if near(x, y) < 2 or 1 in (len(x), len(y)) and x[0] == y[0]) for x in a]
    best: list = [None, None]

    def go(i: int, used: int, cost: int, chosen: tuple[int, ...]) -> None:
        if best[0] is not None and cost >= best[0]:
            return
        if i == len(a):
            best[:] = [cost, chosen]
            return
        for s, j in options[i]:
            if not used >> j & 1:
                go(i + 1, used | 1 << j, cost + s, (*chosen, j))

    go(0, 0, 0, ())
    return None if best[1] is None else [(x, b[j]) for x, j in zip(a, best[1])]


@lru_cache(maxsize=200_000)
def of_body(token: str) -> bool:
    """Whether a token is a word of bodies, abbreviated or not, or a slip away from a long one."""
    if token in BODY or token in PUBLIC or token in SPELT_OUT or len(token) > 1 and ABBREVIATIONS.get(token) in BODY:
        return True
    return len(token) > 7 and any(len(w) > 7 and near(w, token) < 2 for w in BODY)


MASK = (1 << 64) - 1


@lru_cache(maxsize=400_000)
def number(s: str) -> int:
    """A 64-bit number of a string, the same in every process."""
    return int.from_bytes(hashlib.blake2b(s.encode("utf8", "replace"), digest_size=8).digest(), "big")


@lru_cache(maxsize=200_000)
def slips(token: str) -> np.ndarray:
    """The numbers of a token, of its sound, and of what is left of it without one letter."""
    ways = {token, sound(token), *(token[:i] + token[i + 1 :] for i in range(len(token)) if len(token) > 3)}
    return np.array(sorted(number(w) for w in ways), np.uint64)


#: What meets in an entry: all its names; a short form with other short forms and with full ones.
ALL, SHORT, FULL = 0, 1, 2


def entries_of(parser: Parser, name: str) -> dict[int, set[int]]:
    """The index entries of a name by their part: numbers of 64 bits."""
    out: dict[int, set[int]] = {ALL: set(), SHORT: set(), FULL: set()}
    p = parser.parse(name)
    if p.body:
        words = p.words
        for r in [w for w in words if len(w) >= 4 and w not in parser.common and w not in BODY] or words:
            rest = list(words)
            rest.remove(r)
            sign = number(f"b{len(words)}{''.join(sorted(w[0] for w in rest))}")
            out[ALL].update(((slips(r) + np.uint64(sign)) & np.uint64(MASK)).tolist())
        return out
    for q in {p, parser.plain(name)}:
        family, given = q.family, q.given
        if not given or not family:
            out[ALL].add(number(f"1{family or given}"))
            continue
        ways = slips(family)
        for g in {given, q.alias, given + "".join(q.middle)} - {""}:
            if len(g) > 1:
                # a sum: the order of the two tokens doesn't matter
                out[ALL].update(np.add.outer(ways, slips(g)).ravel().tolist())
                out[FULL].update((ways ^ np.uint64(number(f"i{g[0]}"))).tolist())
        if len(given) == 1:
            out[SHORT].update((ways ^ np.uint64(number(f"i{given}"))).tolist())
            continue
        stem = re.sub(r"(.)\1$", r"\1", given[:-1]) if given[-1] in "uiya" else given
        longer = {given[:k] for k in range(3, len(given))} | parser.shorts.get(given, set())
        for part, forms in ((SHORT, [x for x in {given, stem} if len(x) > 2]), (FULL, longer)):
            for x in forms:
                out[part].update((ways ^ np.uint64(number(f"p{x}"))).tolist())
    return out


def tokens_of(name: str) -> list[str]:
    """A name's tokens in lower case: roles, and what it acts through, left out; abbreviations of bodies written out."""
    s = re.split(r"\s+(?:through|thr\.?|rep(?:resented)?\.? by)\s+", name, flags=re.I)[0]
    s = ROLE.sub("", s).lower().replace("m/s", " ").replace("&", " and ")
    raw = [t.strip(".,;:'\"()[]") for t in re.sub(r"\(p\)", " pvt ", s).replace(".", ". ").replace(",", " ").split()]
    raw = [t for t in raw if t]
    body = any(map(of_body, raw))
    return [t for t in (ABBREVIATIONS.get(t, t) if len(t) > 1 else t for t in raw) if t not in FILLERS] if body else raw


def all_names(filings: DataFrame) -> DataFrame:
    """Rows ``(name, n)``: the distinct names of parties, advocates and title sides, white space made single."""
    space = lambda c: F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    title = space(F.col("cause_title.title"))
    verse = r"\s(?:v\.|[vV]s\.?|VS\.?|[vV]/s|[Vv]ersus|VERSUS)\s"
    hit = title.rlike(verse)
    first = F.regexp_extract(title, rf"^(.*?){verse}", 1)
    second = F.regexp_extract(title, rf"^.*?{verse}(.*)$", 1)
    other = r"[\s,]*(?:&|\b(?i:and))\s+(?i:another|others?|anr\.?|ors\.?)\s*$"
    sides = [F.when(hit, F.regexp_replace(x, other, "")) for x in (first, second)]
    listed = [F.transform(c, lambda x: x["name"]) for c in ("petitioners", "respondents", "advocates_on_record")]
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in listed], F.array(*sides))
    return filings.select(F.explode(every).alias("name")).select(space(F.col("name")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``(name, comp)``: the least ``comp`` reachable from each node's own.

    ``nodes`` is ``(name, comp)``, ``edges`` is ``(a, b)`` of comps. Labels spread to their
    neighbours and, through their own labels, on to theirs, until none changes; each round
    is written to the shared folder, none is brought to the driver.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = materialise(both.select("a").distinct().select("a", F.col("a").alias("l")))
    while True:
        least = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(least, "a").select("a", F.least("l", "m").alias("l"))
        up = step.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        new = materialise(step.join(up, "l", "left").select("a", F.coalesce("ll", "l").alias("l")))
        changed = new.join(label.withColumnRenamed("l", "old"), "a").where("l <> old").limit(1).count()
        label = new
        if not changed:
            break
    return nodes.join(label.withColumnRenamed("a", "comp"), "comp", "left").select("name", F.coalesce("l", "comp").alias("comp"))


def name_links(names: DataFrame, nicknames: DataFrame, *, common_share: float = 0.003, least_common: int = 12) -> DataFrame:
    """Rows ``(name, comp)``: the distinct names, and the component (its least name's hash) of each.

    ``nicknames`` is ``(short_name, full_name)``. Tokens in ``common_share`` of the names
    (and ``least_common`` of them) are common; there are at most 1/share times the tokens of
    a name of them, which is what travels to the executors. Null and blank names have no
    row; an empty table gives none.
    """
    names = materialise(names.select("name").where("trim(name) <> ''").distinct())
    total = names.count()

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(t,) for n in pdf["name"] for t in set(tokens_of(n)) if len(t) > 1], columns=["t"])

    often = names.mapInPandas(tokens, "t string").groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= max(least_common, common_share * total))
    common = frozenset(r["t"] for r in often.select("t").collect())
    short: dict[str, set[str]] = {}
    for r in nicknames.select("short_name", "full_name").where("short_name is not null and full_name is not null").distinct().collect():
        short.setdefault(r["short_name"].strip().lower(), set()).add(r["full_name"].strip().lower())
    table = {k: frozenset(v) for k, v in short.items()}

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(common, table)
        for pdf in batches:
            ids, keys, parts = [], [], []
            for i, n in zip(pdf["id"].tolist(), pdf["name"]):
                for part, found in entries_of(parser, n).items():
                    ids += [i] * len(found)
                    keys += found
                    parts += [part] * len(found)
            yield pd.DataFrame({"id": np.array(ids, np.int64), "key": np.array(keys, np.uint64).view(np.int64), "part": np.array(parts, np.int8)})

    entries = spread(names.select(F.xxhash64("name").alias("id"), "name")).mapInPandas(index, "id bigint, key bigint, part tinyint")
    shared = materialise(entries)
    other = shared.select(F.col("id").alias("other"), "key", F.col("part").alias("part2"))
    met = shared.where(F.col("part") != FULL).join(other, "key").where(F.when(F.col("part") == ALL, (F.col("part2") == ALL) & (F.col("id") < F.col("other"))).otherwise((F.col("part2") != ALL) & (F.col("id") != F.col("other"))))
    pairs = met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    spelt = names.select(F.xxhash64("name").alias("id"), "name")
    pairs = pairs.join(spelt, "id").join(spelt.select(F.col("id").alias("other"), F.col("name").alias("name2")), "other").select("name", F.col("name2").alias("other"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(common, table)
        for pdf in batches:
            out = []
            for a, b in zip(pdf["name"], pdf["other"]):
                got = parser.match(a, b)
                if got:
                    out.append((a, b, *got))
            yield pd.DataFrame(out, columns=["a", "b", "level", "side"])

    links = materialise(pairs.mapInPandas(verify, "a string, b string, level int, side int"))
    nodes = names.select("name", F.xxhash64("name").alias("comp"))
    sure = links.where("level = 0").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    nodes = materialise(components(nodes, sure))
    for level in (1, 2, 3, 4, 2, 3, 4):
        a = nodes.select(F.col("name").alias("a"), F.col("comp").alias("ca"))
        b = nodes.select(F.col("name").alias("b"), F.col("comp").alias("cb"))
        across = links.where(F.col("level") == level).join(a, "a").join(b, "b").where("ca <> cb")
        led = across.select(F.when(F.col("side") == 0, F.col("ca")).otherwise(F.col("cb")).alias("low"), F.when(F.col("side") == 0, F.col("cb")).otherwise(F.col("ca")).alias("high"))
        single = led.groupBy("low").agg(F.min("high").alias("a"), F.max("high").alias("z")).where("a = z").select(F.col("low").alias("b"), "a")
        nodes = materialise(components(nodes, single))
    return nodes


def name_variants(filings: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Rows ``(name_a, name_b)``, ``name_a < name_b``: different spellings of one person or body."""
    nodes = name_links(all_names(filings), nicknames)
    other = nodes.select(F.col("name").alias("name_b"), "comp")
    return nodes.withColumnRenamed("name", "name_a").join(other, "comp").where("name_a < name_b").select("name_a", "name_b")
