"""Repair of text from scanned pages: hyphens, misread characters, running headers, page numbers, paragraphs.

The lexicon is counted over the whole corpus: every word that makes up a millionth of
all words or more (so there are a million at most, which bounds what is shipped to the
executors), without those that are a confusion of a far more frequent word.

A page's lines, without page numbers and running lines, become one stream of tokens, in
which each line end is a mark. A lattice over that stream holds the tokens' readings as
they stand, with confusions undone, split in two, merged with a neighbour (a known word
included, and over a line end), or joined over a line end with or without its hyphen; the
cheapest path is the text. It is cut only between tokens that no reading spans.
Paragraph boundaries are then chosen by dynamic programming over the lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouped import per_group
from ..session import materialise, spread

#: What a scanner reads, and what stood there.
CONFUSIONS = [("c", "e"), ("f", "t"), ("!", "i"), ("!", "l"), ("l", "i"), ("cl", "d"), ("ä", "a"), ("á", "a"), ("à", "a"), ("0", "o"), ("5", "s"), ("1", "l"), ("1", "i"), ("ii", "u"), ("q", "g"), ("b", "h"), ("rn", "m"), ("vv", "w"), ("6", "b"), ("h", "li"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("8", "b"), ("9", "g"), ("|", "l")]
MARKS = "-¬‐\xad‑"
DATE = re.compile(r"(?:\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{1,2}-\d{1,2})")
MONTHS = {"January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"}
#: What may be a day or a year with letters for digits, next to a month.
DAY_OR_YEAR = re.compile(r"(?=.*\d)(?=.*[OoIl!SB])(?:[\dOoIl!SB]{1,2}|[\dOoIl!SB]{4})")
TO_DIGIT = str.maketrans({"O": "0", "o": "0", "Q": "0", "I": "1", "l": "1", "!": "1", "|": "1", "i": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "b": "6", "q": "9", "g": "9"})
WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
LINE_END = re.compile(rf"(?<=\w)[{MARKS}][ \t]*\n")
REST = re.compile(r"\s*\w*")
OUTER = ".,;:()[]{}<>\"'“”‘’?…/*—–।-¬‐\xad"
PAGE_NUMBER = re.compile(r"\W*(?:(?:pg|page|p)\.?\s*(?:no\.?)?\s*)?([0-9OoIl!|iSsBZvxVXLCc]{1,7})(?:\s*(?:of|/)\s*[0-9OoIl!|SsBZ]{1,5})?\W*", re.I)
ROMAN = re.compile(r"(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
FOLDS = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("ﬁ", "fi"), ("ﬂ", "fl")]
FOLD = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "6": "b", "8": "b", "9": "g", "q": "g", "c": "e", "f": "t", "ä": "a", "á": "a", "à": "a", "h": "b"})


def roman(s: str) -> int | None:
    """The value of a roman number, None if it isn't one."""
    if not s or not ROMAN.fullmatch(s):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    return sum(-value[a] if b and value[b] > value[a] else value[a] for a, b in zip(s, [*s[1:], ""]))


def misread_date(tokens: list[str]) -> bool:
    """Whether a line's tokens hold a day or a year with letters for digits: a day before or behind a month, a year behind it."""
    for n, token in enumerate(tokens):
        core = token.strip(OUTER)
        if not DAY_OR_YEAR.fullmatch(core):
            continue
        before = [t.strip(OUTER) for t in tokens[max(0, n - 2) : n]]
        if before and before[-1] in MONTHS:
            return True
        if len(core) < 3:
            if n + 1 < len(tokens) and tokens[n + 1].strip(OUTER) in MONTHS and token[-1].isalnum():
                return True
        elif len(before) == 2 and before[0] in MONTHS and before[1].translate(TO_DIGIT).isdigit() and len(before[1]) < 3:
            return True
    return False


def page_number(line: str, pages: set[int]) -> bool:
    """Whether the line is nothing but the number of one of ``pages`` (any number, if none are known)."""
    m = PAGE_NUMBER.fullmatch(line)
    if not m or line.rstrip()[-1:] in ".,;:" and not m[0].lower().lstrip().startswith("p"):
        return False
    raw = m[1]
    digits = raw.translate(TO_DIGIT)
    values = {int(digits)} if digits.isdigit() and any(c.isdigit() or c in "lIO!i|S" for c in raw) else set()
    for form in (raw.lower(), raw.lower().replace("l", "i").replace("!", "i").replace("1", "i")):
        if (r := roman(form)) is not None:
            values.add(r)
    return bool(values & pages) if pages else bool(raw.isdigit())


def line_fold(line: str, page: int | None = None) -> str:
    """A line's key for running headers: page numbers at its ends and misread characters aside."""
    words = line.split()
    for end in (-1, 0):
        n = len(words)
        while n > 2 and (mark := words[end].strip("[](){}|-–—.")) in ("", "Page", "Pg"):
            words.pop(end)
            n -= 1
        if n > 2 and page is not None and (mark.translate(TO_DIGIT) == str(page) or roman(mark.lower()) == page):
            words.pop(end)
            while len(words) > 2 and words[end].strip("[](){}|-–—.") in ("", "Page", "Pg"):
                words.pop(end)
    s = " ".join(words).lower()
    s = re.sub(r"(?:[|\-–—\[(]\s*|\b(?:pg|page|p)\.?\s*(?:no\.?)?\s*)[0-9oil!|]{1,5}(?:\s*of\s*[0-9oil!|]{1,5})?\s*[\])\-–—]?$", "", s).strip()
    s = re.sub(r"^[\[(]?[0-9oil!|]{1,4}\s*[|\])\-–—]\s*", "", s)
    s = re.sub(r"[^\w!|]+", " ", s)
    for a, b in FOLDS:
        s = s.replace(a, b)
    s = s.translate(FOLD)
    for a, b in FOLDS[:5]:
        s = s.replace(a.translate(FOLD), b.translate(FOLD))
    return s.strip(" |!")


# ---------------------------------------------------------------- lexicon


def whole_words(text: str) -> str:
    """The text without words that are broken at a line's end, and without what follows of them."""
    parts, last = [], 0
    for m in LINE_END.finditer(text):
        begin = max(text.rfind(" ", last, m.start()), text.rfind("\n", last, m.start()), last - 1) + 1
        parts.append(text[last:begin])
        last = REST.match(text, m.end()).end()
    return " ".join([*parts, text[last:]]) if parts else text


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """Rows ``(word, n)``: words of lower-case letters, compounds with their hyphens; words broken at a line's end aside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            counts: Counter[str] = Counter()
            for token, n in seen.items():
                for word in WORD.findall(token):
                    counts[word] += n
            return pd.DataFrame({"word": list(counts), "n": list(counts.values())})

        for pdf in batches:
            for t in pdf["_t"]:
                seen.update(whole_words(t.lower()).split())
            if len(seen) > 300_000:
                yield flush()
                seen = Counter()
        if seen and len(done := flush()):
            yield done

    rows = texts.select(F.col(text).alias("_t")).where("_t is not null and _t <> ''")
    return rows.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def readings(word: str) -> Iterator[str]:
    """The words that one confusion makes ``word``."""
    for seen, true in CONFUSIONS:
        at = word.find(seen)
        while at >= 0:
            yield word[:at] + true + word[at + len(seen) :]
            at = word.find(seen, at + 1)


def lexicon(texts: DataFrame, text: str, *, share: float = 1e-6, least: int = 3) -> dict[str, float]:
    """The cost (minus log probability) of each word with at least ``share`` of all words and ``least`` places."""
    counts = word_counts(texts, text)
    total = counts.agg(F.sum("n")).scalar()
    rows = counts.where((F.col("n") >= F.lit(share) * total) & (F.col("n") >= least)).collect()
    n = {r["word"]: r["n"] for r in rows}
    # parts of compounds are words, too
    for w in list(n):
        if "-" in w:
            for part in w.split("-"):
                if part not in n and len(part) > 2:
                    n[part] = n[w]
    good = {w: k for w, k in n.items() if len(w) < 3 or not any(n.get(r, 0) >= 20 * k for r in readings(w))}
    whole = max(1, sum(good.values()))
    return {w: -math.log(k / whole) for w, k in good.items()}


# ---------------------------------------------------------------- decoding


@dataclass
class Page:
    """What was found in a text: kinds of lines (counted from 1), and the readings of tokens."""

    kinds: list[tuple[int, str]] = field(default_factory=list)
    pending: tuple[int, str, str] | None = None  # a hyphen behind the last word: line, left part, mark
    head: str = ""  # the first text line
    lines: list[str] = field(default_factory=list)  # repaired text lines, with blank ones


UNKNOWN, CONFUSED, MERGED, SPLIT, SPLIT_MORE = 25.0, 6.0, 5.0, 7.0, 2.0
#: A hyphen kept at a line's end, one between two words that make no known compound, one kept at a soft mark, a mark left as it stands, and each line between a word's parts.
HYPHEN, COMPOUND, SOFT, BROKEN, FAR = 3.0, 6.0, 30.0, 40.0, 16.0
LEFT = re.compile(r"([^\W\d_][\w!|]*|[\w!|]*[^\W\d_])$")
RIGHT = re.compile(r"[\w!|]*[^\W\d_][\w!|]*")


def short(token: str) -> bool:
    """Whether a token may be a part of a word set with blanks between its letters."""
    core = token.strip(OUTER)
    return 0 < len(core) < 3 and core.isalpha()


class Decoder:
    """Decodes streams of tokens by a lexicon; remembers what it made of each token."""

    def __init__(self, costs: dict[str, float]):
        self.costs = costs
        self.known: set[str] = set()
        self.seen: dict[str, tuple[float, str, bool]] = {}
        self.cuts: dict[str, tuple[float, str] | None] = {}

    def word(self, core: str) -> tuple[float, str, bool]:
        """The cheapest reading of one word: its cost, the reading, whether a confusion was undone."""
        low = core.lower()
        if (c := self.costs.get(low)) is not None:
            return c, core, False
        best = (UNKNOWN + 0.5 * len(low), core, False)
        if len(low) < 3 or not any(ch.isalpha() for ch in low):
            return best
        once = list(dict.fromkeys(readings(low)))
        for r in once:
            c = self.costs.get(r)
            if c is not None and c + CONFUSED < best[0]:
                best = (c + CONFUSED, r, True)
        if not best[2] and len(low) >= 6:
            for r in once:
                for rr in readings(r):
                    c = self.costs.get(rr)
                    if c is not None and c + 2 * CONFUSED + 3 < best[0]:
                        best = (c + 2 * CONFUSED + 3, rr, True)
        if not best[2] and re.fullmatch(r"[A-Z]?[a-z]*(?:[!01568ä][a-z]*){1,2}", core) and re.search(r"[a-z]{2}", core) and re.search(r"[a-z][!01568ä][a-z]|^[!01568ä][a-z]{3}|[a-z]{3}[01568ä]$", core):
            # a digit or mark inside a word that no lexicon holds, as in a name
            best = (UNKNOWN, core.translate(str.maketrans("!0156ä8", "iolsbab")), True)
        if best[2]:
            return best[0], best[1].upper() if core.isupper() and len(core) > 1 else best[1].capitalize() if core[0].isupper() else best[1], True
        return best

    def token(self, token: str) -> tuple[float, str, bool]:
        """The cheapest reading of a token, whatever stands around its words."""
        got = self.seen.get(token)
        if got is None:
            got = self.seen[token] = self._token(token)
            if not got[2] and got[0] < UNKNOWN and not DAY_OR_YEAR.fullmatch(token.strip(OUTER)):
                self.known.add(token)
            if len(self.seen) > 400_000:
                self.seen, self.known = {}, set()
        return got

    def _token(self, token: str) -> tuple[float, str, bool]:
        core = token.strip(OUTER)
        if not core:
            return 0.0, token, False
        at = token.index(core)
        put = lambda s: token[:at] + s + token[at + len(core) :]
        if any(c.isdigit() for c in core) and DATE.fullmatch(core.translate(TO_DIGIT)):
            return 5.0, put(core.translate(TO_DIGIT)), not DATE.fullmatch(core)
        if "@" in core or "(at)" in core or "www." in core or core.isdigit() or re.search(r"[.:/]\w", core) and re.search(r"\d", core):
            return 5.0, token, False
        if core.endswith("!") and core[:-1].lower() in self.costs:
            return self.costs[core[:-1].lower()], token, False
        if re.fullmatch(r"[0-9a-f]{4,}", core) and sum(c.isdigit() for c in core) > 1 or re.fullmatch(r"[A-Z0-9]*\d[A-Z0-9]*", core) and sum(c.isdigit() for c in core) > 1 or re.fullmatch(r"\d+(?:st|nd|rd|th|[A-Z])?", core):
            return 5.0, token, False
        if core.lower() in self.costs:
            return self.costs[core.lower()], token, False
        cost, out, changed = 0.0, "", False
        for piece in re.split(r"([^\w!|]+)", core):
            if piece and (piece[0].isalnum() or piece[0] in "!|"):
                c, piece, ch = self.word(piece)
                cost, changed = max(cost, c), changed or ch
            out += piece
        return cost, put(out), changed

    def ends(self, left: str, right: str, mark: str) -> list[tuple[float, str, bool, bool]]:
        """The readings of a word broken at a line's end: (cost, text, hyphen dropped, confusion undone)."""
        out = []
        soft = SOFT if mark in "¬\xad" else 0.0
        goes_on = right[:1].islower() or left.isupper() and right.isupper()
        c, word, ch = self.word(left + right)
        if c < UNKNOWN or goes_on and (soft or len(left) + len(right) > 3):
            out.append((c, word, True, ch))
        c_hyph = self.costs.get(f"{left}-{right}".lower())
        c_left, c_right = self.costs.get(left.lower()), self.costs.get(right.lower())
        if c_hyph is not None:
            out.append((c_hyph + HYPHEN + soft, f"{left}-{right}", False, False))
        elif goes_on and c_left is not None and c_right is not None and len(left) > 2 and len(right) > 2:
            out.append((min(c_left + c_right + COMPOUND, UNKNOWN) + soft, f"{left}-{right}", False, False))
        if goes_on and not any(x[0] < UNKNOWN for x in out):
            out += [(self.costs[r] + CONFUSED + soft, r, False, True) for r in readings(f"{left}-{right}".lower()) if r in self.costs]
        return out

    def join(self, left: str, right: str, mark: str) -> tuple[str | None, bool, bool]:
        """How a word broken at a line's end reads: (reading or None, hyphen dropped, confusion undone)."""
        return min(self.ends(left, right, mark), key=lambda x: x[0], default=(0.0, None, False, False))[1:]

    def merge(self, left: str, right: str) -> tuple[float, str, bool] | None:
        """Two tokens as one word of the lexicon: its cost, the reading, whether a confusion was undone."""
        a, b = left.lstrip(OUTER), right.rstrip(OUTER)
        if not (b.islower() and a.isalpha() and b.isalpha()):
            return None
        c, word, ch = self.costs.get((a + b).lower()), a + b, False
        if c is None:
            known = (a.lower() in self.costs) + (b in self.costs)
            if known == 2 or len(a) + len(b) < 5 or known and not any(r in self.costs for r in readings((a + b).lower())):
                return None
            c, word, ch = self.word(a + b)
            if c >= UNKNOWN:
                return None
        return c + MERGED, left[: len(left) - len(a)] + word + right[len(b) :], ch

    def split(self, core: str) -> tuple[float, str] | None:
        """An unknown token as several words of the lexicon: the cost and the reading; where one blank is lost, more may be."""
        got = self.cuts.get(core)
        if got is None and core not in self.cuts:
            n = len(core)
            best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
            for end in range(2, n + 1):
                for at in range(max(0, end - 30), end - 1):
                    c = self.costs.get(core[at:end])
                    if c is not None and best[at][0] + c + SPLIT_MORE < best[end][0]:
                        best[end] = (best[at][0] + c + SPLIT_MORE, at)
            parts, end = [], n
            while end and best[end][0] < math.inf:
                parts.append(core[best[end][1] : end])
                end = best[end][1]
            if not end and (len(parts) > 2 or len(parts) == 2 and min(map(len, parts)) > 2):
                got = (best[n][0] - 2 * SPLIT_MORE + SPLIT, " ".join(parts[::-1]))
            if len(self.cuts) > 100_000:
                self.cuts = {}
            self.cuts[core] = got
        return got

    def again(self, left: str, right: str) -> tuple[float, str] | None:
        """Two unknown tokens cut into words anew, as where a blank slipped: the cost and the reading."""
        a, b = left.lstrip(OUTER), right.rstrip(OUTER)
        if not (a.isalpha() and b.isalpha() and a.islower() and b.islower()) or min(self.token(left)[0], self.token(right)[0]) < UNKNOWN:
            return None
        cut = self.split(a + b)
        return cut and (cut[0] + MERGED, left[: len(left) - len(a)] + cut[1] + right[len(b) :])

    def spaced(self, tokens: list[str], at: int, to: int) -> Iterator[tuple[int, float, str]]:
        """Words of the lexicon set with blanks between their letters from ``tokens[at]`` on: (end, cost, text); three parts at least."""
        whole = tokens[at].lstrip(OUTER)
        lead = tokens[at][: len(tokens[at]) - len(whole)]
        for j in range(at + 1, min(to, at + 30)):
            part = tokens[j].rstrip(OUTER)
            if not short(part) or not whole.isalpha():
                return
            whole += part
            if j - at > 1 and (c := self.costs.get(whole.lower())) is not None:
                yield j + 1, c + MERGED + (j - at), lead + whole + tokens[j][len(part) :]
            if len(part) < len(tokens[j]):
                return

    def stream(self, tokens: list[str], goes_on: dict[int, list[int]], at: int, to: int) -> list[tuple]:
        """The cheapest reading of ``tokens[at:to]``: (text, place, place of its other part, hyphen dropped, confusion undone, and of several other parts their places) in order.

        ``goes_on`` has, for tokens that end in a mark at a line's end, the first tokens of the
        next lines; a part taken from behind other lines is passed over where it stands.
        """
        best: list[dict[int | None, tuple]] = [{} for _ in range(to - at + 3)]
        best[0][None] = (0.0, None, None, None)

        def relax(i: int, taken: int | None, cost: float, piece: tuple | None, i0: int, taken0: int | None) -> None:
            old = best[i - at].get(taken)
            if old is None or cost < old[0]:
                best[i - at][taken] = (cost, piece, i0, taken0)

        for i in range(at, to):
            token = tokens[i]
            for taken, (cost, *_) in list(best[i - at].items()):
                if taken == i:
                    relax(i + 1, None, cost, None, i, taken)
                    continue
                c, text, ch = self.token(token)
                if i in goes_on:
                    relax(i + 1, taken, cost + c + BROKEN, (text, i, None, False, ch), i, taken)
                    left = LEFT.search(token[:-1])[0]
                    for n, j in enumerate(goes_on[i]):
                        right = RIGHT.match(tokens[j])[0]
                        rest = tokens[j][len(right) :]
                        for c, word, dropped, ch in self.ends(left, right, token[-1]):
                            piece = (token[: -1 - len(left)] + word + rest, i, j, dropped, ch)
                            if j == i + 1 and taken != j:
                                relax(i + 2, taken, cost + c, piece, i, taken)
                            elif j > i + 1 and taken is None and c < UNKNOWN:
                                relax(i + 1, j, cost + c + (n or 1) * FAR, piece, i, taken)
                    continue
                relax(i + 1, taken, cost + c, (text, i, None, False, ch), i, taken)
                if c >= UNKNOWN and (core := token.strip(OUTER)).isalpha() and core.islower() and (cut := self.split(core)):
                    relax(i + 1, taken, cost + cut[0], (token.replace(core, cut[1]), i, None, False, False), i, taken)
                if short(token) and (taken is None or taken < i):
                    for j, c_all, whole in self.spaced(tokens, i, to):
                        relax(j, taken, cost + c_all, (whole, i, None, False, False, range(i + 1, j)), i, taken)
                if i + 1 < to and taken != i + 1 and i + 1 not in goes_on and (cut := self.again(token, tokens[i + 1])):
                    relax(i + 2, taken, cost + cut[0], (cut[1], i, i + 1, False, False), i, taken)
                if i + 1 < to and taken != i + 1 and i + 1 not in goes_on and (m := self.merge(token, tokens[i + 1])):
                    relax(i + 2, taken, cost + m[0], (m[1], i, i + 1, False, m[2]), i, taken)
        out, i, taken = [], to, None
        while i > at:
            _, piece, i, taken = best[i - at][taken]
            if piece:
                out.append(piece)
        return out[::-1]

    def read(self, text: str, pages: set[int], headers: set[int], repair: bool = False) -> Page:
        """Finds hyphens, misread words and page numbers in a text; with ``repair`` also its lines as they read."""
        out = Page()
        lines = text.split("\n")
        body = []
        for i, line in enumerate(lines, 1):
            if i in headers:
                out.kinds.append((i, "header"))
            elif page_number(line, pages):
                out.kinds.append((i, "page_number"))
            elif line.strip():
                body.append(i)
        out.head = lines[body[0] - 1] if body else ""
        misread: set[int] = set()
        tokens: list[str] = []
        of: list[int] = []  # the line of each token
        first: list[int] = []  # the first token of each body line
        hot: set[int] = set()
        for i in body:
            found = lines[i - 1].split()
            first.append(len(tokens))
            if not self.known.issuperset(found):
                for n, t in enumerate(found, len(tokens)):
                    if t not in self.known and ((got := self.token(t))[0] >= UNKNOWN or got[2]):
                        hot.add(n)
                # what may be a misread day or year is never a known token
                if misread_date(found):
                    misread.add(i)
            tokens += found
            of += [i] * len(found)
        goes_on: dict[int, list[int]] = {}
        end = len(tokens)
        for k, n in enumerate([*first[1:], len(tokens)] if body else []):
            t = tokens[n - 1]
            if t[-1] not in MARKS or not (m := LEFT.search(t[:-1])):
                continue
            if n == len(tokens):
                # the next page settles it
                out.pending = (of[n - 1], m[0], t[-1])
                end = n - 1
                continue
            # lines put in between may stand before the rest of the word: as many as cost no more than to leave it broken
            far = int((BROKEN + UNKNOWN + 0.5 * len(t)) / FAR) + 1
            rest = [j for j in first[k + 1 : k + 2 + far] if RIGHT.match(tokens[j]) and (j < len(tokens) - 1 or tokens[j][-1] not in MARKS)]
            near = rest and rest[0] == n and min((x[0] for x in self.ends(m[0], RIGHT.match(tokens[n])[0], t[-1])), default=UNKNOWN) < UNKNOWN
            goes_on[n - 1] = rest[:1] if near else rest
            hot.add(n - 1)
        if repair:
            hot |= {n for n, (a, b) in enumerate(zip(tokens, tokens[1:])) if (a + b).lower() in self.costs or not b[-1].isalnum() and (a + b.rstrip(OUTER)).lower() in self.costs or not a[0].isalnum() and (a + b).strip(OUTER).lower() in self.costs}
        spans = lambda n: n not in goes_on and n + 1 < end and n + 1 not in goes_on and (self.merge(tokens[n], tokens[n + 1]) is not None or short(tokens[n]) and short(tokens[n + 1]) or self.again(tokens[n], tokens[n + 1]) is not None)
        fixed: dict[int, str] = {}
        gone: set[int] = set()
        to = 0
        for h in sorted(hot):
            if h < to or h >= end:
                continue
            at, last = h, h
            while at > to and spans(at - 1):
                at -= 1
            n = at
            while n <= last:
                last = max(last, *goes_on.get(n, ()), n + 1 if spans(n) else n)
                n += 1
            to = last + 1
            for put, n, j, dropped, changed, *over in self.stream(tokens, goes_on, at, to):
                fixed[n] = put
                gone.update(*over)
                if j is not None:
                    gone.add(j)
                if dropped:
                    out.kinds.append((of[n], "hyphen"))
                if changed:
                    whole = [c for x in ([n] if j is None else [n, j]) for c in tokens[x].lower().rstrip(OUTER if x == n and j is not None else "")]
                    p = next((p for p, (a, b) in enumerate(zip(whole, put.lower().replace("-", "") if j is not None else put.lower())) if a != b), 0)
                    misread.add(of[n] if j is None or p < len(tokens[n].rstrip(OUTER)) else of[j])
        out.kinds += [(i, "misread") for i in sorted(misread)]
        if repair:
            marked = {i for i, k in out.kinds if k in ("header", "page_number")}
            per: dict[int, list[str]] = {i: [] for i in body}
            for n, t in enumerate(tokens):
                if n not in gone:
                    per[of[n]].append(fixed.get(n, t))
            for i in range(1, len(lines) + 1):
                # a line whose only word went to the line before is no gap
                if i not in marked and (i not in per or per[i]):
                    out.lines.append(" ".join(per.get(i, ())))
        return out


#: What stands before a line: a blank line, a page's end (else nothing, 0).
GAP, PAGE_END = 1, 2


def paragraphs(lines: list[str]) -> list[str]:
    """Joins lines to paragraphs: the boundaries whose total cost is least."""
    return [p for _, p in page_paragraphs([lines])]


def page_paragraphs(pages: list[list[str]]) -> list[tuple[int, str]]:
    """The paragraphs of pages that follow each other, each with the number of the page it begins on, from 0.

    A paragraph costs by its boundaries (cheap behind a blank line, or where a short line
    ends a sentence) and by the short or ending lines it runs over. Linear in the lines:
    a boundary's cost depends on the two lines it parts.
    """
    text, blank, of = [], [], []
    for k, lines in enumerate(pages):
        # what is blank around a page's text says nothing: a page's end may be a gap between paragraphs
        gap: int = PAGE_END if k else GAP
        inside_page = False
        for line in lines:
            if line.strip():
                text.append(line.strip())
                blank.append(gap)
                of.append(k)
                gap, inside_page = 0, True
            elif inside_page:
                gap = GAP
    if not text:
        return []
    width = sorted(map(len, text))[int(0.8 * (len(text) - 1))]
    best: list[tuple[float, int]] = [(0.0, 0)]  # cost of the first i lines, ending in a boundary, and where their last paragraph begins
    inside = math.inf  # cost of the first i lines with the last paragraph still open
    begin = 0
    for i in range(len(text)):
        cut, run = (0.0, 1.0)
        if i:
            ends = text[i - 1][-1:] in ".?!:।۔"
            short = len(text[i - 1]) < 0.75 * width
            starts = not text[i][0].islower()
            cut = (2.0, 0.2, 1.0)[blank[i]] + (0.0 if ends else 1.5) + (0.0 if short else 0.7) + (0.0 if starts else 3.0)
            run = (0.0, 2.2, 0.8)[blank[i]] + (1.4 if ends and short and starts else 0.0)
        fresh = best[i][0] + (cut if i else 0.0)
        if i == 0 or fresh < inside + run:
            inside, begin = fresh, i
        else:
            inside += run
        best.append((inside, begin))
    out, end = [], len(text)
    starts = []
    while end > 0:
        starts.append(best[end][1])
        end = best[end][1]
    starts.reverse()
    for a, b in zip(starts, [*starts[1:], len(text)]):
        out.append((of[a], " ".join(text[a:b])))
    return out


# ---------------------------------------------------------------- running lines and pages


def running_lines(pages: DataFrame, least: int = 2) -> DataFrame:
    """Rows ``(_id, _heads)``: the line numbers of each page's running headers and footers.

    ``pages`` has ``_id, _group, _page, _t``. A running line has nothing but running lines
    and page numbers between it and the page's top or bottom, however many, and is found,
    misread characters aside, on at least ``least`` pages of its group, at places that differ
    by two lines at most, counted from the top or from the bottom.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, g, p, t in zip(pdf["_id"], pdf["_group"], pdf["_page"], pdf["_t"]):
                own = int(p) if p == p and p is not None else None
                at, found = [], []
                for n, x in enumerate(t.split("\n"), 1):
                    if x.strip():
                        at.append(n)
                        found.append("#" if page_number(x, {own} if own is not None else set()) else line_fold(x, own))
                out.append((i, g, p, at, found))
            yield pd.DataFrame(out, columns=["_id", "_group", "_page", "_nos", "_keys"])

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, nos, found, often in zip(pdf["_id"], pdf["_nos"], pdf["_keys"], pdf["_often"]):
                often, n = set(often.tolist()), len(nos)
                marked = set()
                for order in (range(n), range(n - 1, -1, -1)):
                    for k in order:
                        if k in often:
                            marked.add(int(nos[k]))
                        elif found[k] != "#":
                            break
                if marked:
                    out.append((i, sorted(marked)))
            yield pd.DataFrame(out, columns=["_id", "_heads"])

    kind = pages.schema["_id"].dataType.simpleString()
    rows = materialise(pages.mapInPandas(keys, f"_id {kind}, _group string, _page double, _nos array<int>, _keys array<string>"))
    # lines travel as hashes of group and key
    key = F.xxhash64("_group", "_key").alias("_k")
    lines = rows.select("_id", "_group", "_page", F.size("_keys").alias("_size"), F.posexplode("_keys").alias("_at", "_key")).where("_key <> '#' and length(_key) > 3").select("_id", "_page", "_size", "_at", key)
    often = lines.groupBy("_k").agg(F.count_distinct("_page").alias("_n")).where(F.col("_n") >= least).select("_k")
    again = lines.join(often, "_k", "left_semi")
    # places two lines apart or less share a slot
    slots = [F.struct(F.lit(side).alias("side"), (place + d).alias("slot")) for side, place in ((0, F.col("_at")), (1, F.col("_size") - 1 - F.col("_at"))) for d in (-1, 0, 1)]
    placed = again.select("_id", "_page", "_at", "_k", F.explode(F.array(*slots)).alias("_p")).select("_id", "_page", "_at", "_k", F.col("_p.side").alias("_side"), F.col("_p.slot").alias("_slot"))
    slot = ["_k", "_side", "_slot"]
    fit = placed.groupBy(*slot).agg(F.count_distinct("_page").alias("_n")).where(F.col("_n") >= least).select(*slot)
    kept = placed.join(fit, slot, "left_semi")
    per = kept.groupBy("_id").agg(F.collect_set("_at").alias("_often"))
    return rows.select("_id", "_nos", "_keys").join(per, "_id").mapInPandas(heads, f"_id {kind}, _heads array<int>")


def _reader(costs: dict[str, float], emit: Callable[[pd.DataFrame, Decoder], Iterator[tuple]], columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(costs)
        for pdf in batches:
            yield pd.DataFrame(list(emit(pdf, decoder)), columns=columns)

    return run


def _set(x) -> set[int]:
    return set() if x is None else {int(v) for v in x if v is not None and v == v}


def noise(pages: DataFrame, costs: dict[str, float], *, grouped: bool) -> DataFrame:
    """Rows ``(_id, line_no, kind)`` of ``pages`` (``_id, _group, _page, _pages, _t``).

    With ``grouped`` running lines of a group's pages are found, and a word broken at a
    page's end goes on at the head of the group's next page; is that page lost, null or
    empty, its end is no hyphen. Null and empty texts give no rows.
    """
    kind = pages.schema["_id"].dataType.simpleString()
    if grouped:
        pages = pages.join(running_lines(pages.select("_id", "_group", F.col("_page").cast("double").alias("_page"), "_t")).withColumnRenamed("_id", "_rid"), F.col("_id") == F.col("_rid"), "left").drop("_rid")
    else:
        pages = pages.withColumn("_heads", F.lit(None).cast("array<int>"))

    def emit(pdf: pd.DataFrame, decoder: Decoder) -> Iterator[tuple]:
        for i, ps, t, heads in zip(pdf["_id"], pdf["_pages"], pdf["_t"], pdf["_heads"]):
            page = decoder.read(t, _set(ps), _set(heads))
            yield from ((i, n, k, None, None) for n, k in page.kinds)
            if grouped:
                if page.pending:
                    yield (i, page.pending[0], "pending", page.pending[1], page.pending[2])
                if page.head:
                    yield (i, 0, "head", page.head, None)

    found = pages.select("_id", "_pages", "_t", "_heads").mapInPandas(_reader(costs, emit, ["_id", "line_no", "kind", "_a", "_b"]), f"_id {kind}, line_no bigint, kind string, _a string, _b string")
    if not grouped:
        return found.select("_id", "line_no", "kind")
    found = materialise(found)
    where = pages.select("_id", "_group", F.col("_page").cast("bigint").alias("_page"))
    pend = found.where("kind = 'pending'").join(where, "_id")
    head = found.where("kind = 'head'").select("_id", F.col("_a").alias("_head")).join(where, "_id").select(F.col("_group").alias("_g2"), (F.col("_page") - 1).alias("_p2"), "_head").dropDuplicates(["_g2", "_p2"])
    both = pend.join(head, F.col("_group").eqNullSafe(F.col("_g2")) & (F.col("_page") == F.col("_p2")))

    def decide(pdf: pd.DataFrame, decoder: Decoder) -> Iterator[tuple]:
        for i, n, left, mark, h in zip(pdf["_id"], pdf["line_no"], pdf["_a"], pdf["_b"], pdf["_head"]):
            r = re.match(r"\s*([\w!|]*[^\W\d_][\w!|]*)", h)
            if r:
                word, dropped, changed = decoder.join(left, r[1], mark)
                if word is not None and dropped:
                    yield (i, n, "hyphen")
                if word is not None and changed and left.lower() != word.lower()[: len(left)]:
                    yield (i, n, "misread")

    ends = both.select("_id", "line_no", "_a", "_b", "_head").mapInPandas(_reader(costs, decide, ["_id", "line_no", "kind"]), f"_id {kind}, line_no bigint, kind string")
    return found.where("kind not in ('pending', 'head')").select("_id", "line_no", "kind").unionByName(ends).distinct()


def over_pages(decoder: Decoder, ends: Page, goes_on: Page) -> None:
    """Joins the word broken at a page's end, with a mark or without, to the head of the next page, whose rest it leaves."""
    at = next((k for k in range(len(ends.lines) - 1, -1, -1) if ends.lines[k].strip()), None)
    to = next((k for k, line in enumerate(goes_on.lines) if line.strip()), None)
    if at is None or to is None:
        return
    before, last = ends.lines[at].split(), goes_on.lines[to].split()
    left, right = before[-1], last[0]
    put = None
    if ends.pending:
        _, part, mark = ends.pending
        # the head as it stands, before its first word was read alone
        r = RIGHT.match(goes_on.head.split()[0])
        if r and left.endswith(part + mark):
            word = decoder.join(part, r[0], mark)[0]
            if word is not None:
                token = goes_on.head.split()[0]
                put = left[: -len(part) - 1] + word + token[r.end() :]
    elif (m := decoder.merge(left, right)) and m[0] < decoder.token(left)[0] + decoder.token(right)[0]:
        put = m[1]
    if put is not None:
        ends.lines[at] = " ".join([*before[:-1], put])
        goes_on.lines[to] = " ".join(last[1:])
        if not goes_on.lines[to]:
            # no gap, as its only word went to the page before
            del goes_on.lines[to]


def filing_paragraphs(rows: list[dict], decoder: Decoder) -> Iterator[tuple]:
    """Rows ``(id, paragraph_no, paragraph)`` of one filing's pages, given by page; a lost page parts its neighbours.

    A paragraph belongs to the page it begins on. Of several rows for one page number the
    first stands between the pages before and behind, the others are read alone.
    """
    chain: list[tuple] = []
    last = None

    def close() -> Iterator[tuple]:
        count: Counter[int] = Counter()
        for k, p in page_paragraphs([page.lines for _, page in chain]):
            count[k] += 1
            yield (chain[k][0], count[k], p)
        chain.clear()

    alone = []
    for r in rows:
        page = decoder.read(r["_t"], _set(r["_pages"]), _set(r["_heads"]), repair=True)
        number = r["_page"]
        if number is not None and number == last:
            alone.append((r["_id"], page))
            continue
        if chain and number is not None and last is not None and number == last + 1 and page.head and chain[-1][1].head:
            over_pages(decoder, chain[-1][1], page)
        else:
            yield from close()
        chain.append((r["_id"], page))
        last = number
    yield from close()
    for one in alone:
        chain.append(one)
        yield from close()


def repaired(pages: DataFrame, costs: dict[str, float], *, grouped: bool) -> DataFrame:
    """Rows ``(_id, paragraph_no, paragraph)``: the texts as continuous paragraphs, counted from 1.

    With ``grouped`` words and paragraphs run on from page to page of a group; a paragraph
    is given for the page it begins on, so a page that begins none has no rows.
    """
    kind = pages.schema["_id"].dataType.simpleString()
    if grouped:
        pages = pages.join(running_lines(pages.select("_id", "_group", F.col("_page").cast("double").alias("_page"), "_t")).withColumnRenamed("_id", "_rid"), F.col("_id") == F.col("_rid"), "left").drop("_rid")
        decoder = Decoder(costs)
        # pages without a group are groups of their own
        keyed = pages.select(F.struct("_group", F.when(F.col("_group").isNull(), F.col("_id")).alias("_own")).alias("_key"), "_id", F.col("_page").cast("bigint").alias("_page"), "_pages", "_t", "_heads")
        return per_group(keyed, ["_key"], ["_page", "_id"], lambda rows: filing_paragraphs(rows, decoder), f"_pid {kind}, paragraph_no bigint, paragraph string").select(F.col("_pid").alias("_id"), "paragraph_no", "paragraph")
    pages = pages.withColumn("_heads", F.lit(None).cast("array<int>"))

    def emit(pdf: pd.DataFrame, decoder: Decoder) -> Iterator[tuple]:
        for i, ps, t, heads in zip(pdf["_id"], pdf["_pages"], pdf["_t"], pdf["_heads"]):
            for n, p in enumerate(paragraphs(decoder.read(t, _set(ps), _set(heads), repair=True).lines), 1):
                yield (i, n, p)

    return pages.select("_id", "_pages", "_t", "_heads").mapInPandas(_reader(costs, emit, ["_id", "paragraph_no", "paragraph"]), f"_id {kind}, paragraph_no bigint, paragraph string")


def chunk_pages(chunks: DataFrame) -> DataFrame:
    """The chunks as pages: repeated record ids once, with the pages they may be numbered by."""
    spans = F.array_distinct(F.concat(F.array("primary_page", "page_start", "page_end"), F.coalesce(F.transform("source_pages", lambda x: x.try_cast("int")), F.array().cast("array<int>"))))
    one = chunks.select(F.col("record_id").alias("_id"), F.lit(None).cast("string").alias("_group"), F.col("primary_page").alias("_page"), spans.alias("_pages"), F.col("chunk_text").alias("_t"))
    return spread(one.where("_t is not null and _t <> ''"))


def text_pages(page_text: DataFrame) -> DataFrame:
    """The rows of page_text as pages: repeated page ids once."""
    rows = spread(page_text.where("normalized_text is not null and normalized_text <> ''"))
    one = rows.select(F.col("page_id").cast("string").alias("_id"), F.col("filing_id").alias("_group"), F.col("page").alias("_page"), F.array("page").alias("_pages"), F.col("normalized_text").alias("_t"))
    return one.dropDuplicates(["_id"])


def corpus_lexicon(chunks: DataFrame, page_text: DataFrame) -> dict[str, float]:
    """The lexicon of both tables."""
    return lexicon(chunks.select(F.col("chunk_text").alias("t")).unionByName(page_text.select(F.col("normalized_text").alias("t"))), "t")


def scan_noise(spark: SparkSession, chunks: DataFrame, page_text: DataFrame) -> DataFrame:
    """Rows ``(origin, row_id, line_no, kind)`` of both tables, one row per distinct case."""
    costs = corpus_lexicon(chunks, page_text)
    a = noise(chunk_pages(chunks), costs, grouped=False).select(F.lit("chunks").alias("origin"), F.col("_id").alias("row_id"), "line_no", "kind").distinct()
    b = noise(text_pages(page_text), costs, grouped=True).select(F.lit("page_text").alias("origin"), F.col("_id").alias("row_id"), "line_no", "kind")
    return a.unionByName(b)


def scan_repaired(spark: SparkSession, chunks: DataFrame, page_text: DataFrame) -> DataFrame:
    """Rows ``(origin, row_id, paragraph_no, paragraph)`` of both tables."""
    costs = corpus_lexicon(chunks, page_text)
    a = repaired(chunk_pages(chunks), costs, grouped=False).select(F.lit("chunks").alias("origin"), F.col("_id").alias("row_id"), "paragraph_no", "paragraph").distinct()
    b = repaired(text_pages(page_text), costs, grouped=True).select(F.lit("page_text").alias("origin"), F.col("_id").alias("row_id"), "paragraph_no", "paragraph")
    return a.unionByName(b)
