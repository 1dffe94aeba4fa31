"""Personal information in free text, found by a skip-chain conditional random field.

A text becomes tokens; each token has a class: a word of the trained vocabulary, or the
shape of anything else. A chain of labels (begin and inside of person, email, phone,
id_number, address, or none) has potentials for each pair of neighbours and for the
classes of the two tokens before, of the token and of the two behind. Tokens of a text
that are alike (the same letters, or letters that scans exchange) are joined by skip edges,
whose potential favours the same kind of entity; loopy belief propagation passes messages
along chains and skip edges in turn, each without what its receiver said before, so a name
that is plain in one place is found in all others.

The weights are fitted here, by maximum likelihood with ``fit``, on a bounded sample of
texts labelled by cue patterns (``silver``). All texts are decoded, whole: what the sample
lacks shapes the weights alone, not where entities are looked for. A bound closes most
places before the chains are summed (``Finder.open_places``): those where no run of labels,
as good as it may be, outweighs none. The best labels are the same with it and without.
At last the ends of the found spans are checked against exact patterns.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .threads import one_thread

KINDS = ["person", "email", "phone", "id_number", "address"]
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
N = len(LABELS)
TYPE = np.array([0, *[i + 1 for i in range(len(KINDS)) for _ in "BI"]])
BREAK = r"[-¬‐\xad‑]\n[ \t]*"
AT = r"(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?)"
DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)"
EMAIL = re.compile(rf"[A-Za-z0-9][\w.+-]*(?:{BREAK}[\w.+-]+)?{AT}(?:{BREAK})?[A-Za-z0-9-]+(?:{DOT}(?:{BREAK})?[A-Za-z0-9-]*[A-Za-z0-9])+")
PHONE = re.compile(r"(?<![\w/.,-])(?:(?:\+91|0091)[\s.-]?(?:\d{10}|\d{5}[\s-]\d{5}|\d{3}[.\s-]\d{3}[.\s-]\d{4}|\d{4}[\s-]\d{3}[\s-]\d{3})|\(0\d{2,4}\)\s?\d{3}\s?\d{3,4}|0\d{2,4}-\d{3}\s?\d{3,4}|0?\d{10}|\d{5}-\d{5}|\d{5}\s\d{5}|\d{4}\s\d{3}\s\d{3}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w/]|[,.-]\d)")
ID = re.compile(r"(?<![\w/.,-])(?:[A-Z]{5}\s?\d{4}\s?[A-Z]|[A-Z]{3}\s?\d{7}|[A-Z]\s?\d{7}|\d{4}[\s-]\d{4}[\s-]\d{4}|\d{12})(?![\w/]|[,.-]\d)")
WORD_ = rf"[A-Z][A-Za-z]*(?:{BREAK}[a-z]+)?"
NUMBER_ = r"\d+(?:st|nd|rd|th)?(?:-[A-Z])?"
PART = rf"(?:(?:near|opp\.?|behind)\s+)?(?!(?:Ph|Tel|Mob|PIN)\b)(?:(?:Tal|Dist|P\.O|Teh)\.\s+)?(?:(?:{WORD_}|{NUMBER_})(?:\s+(?:No\.\s*)?(?:{WORD_}|{NUMBER_}))*(?:\s+No\.\s*\d+(?:-[A-Z])?)?)"
HOUSE = r"(?:(?:House|Plot|Door|Shop|Qtr\.?|H\.|Quarter)\s+No\.?\s*(?:[A-Z]-)?\d+(?:/\d+)?(?:-?[A-Z](?![a-z]))?|Flat\s+(?:No\.?\s*)?(?:[A-Z]-)?\d+(?:/\d+)?-?[A-Z]?(?![a-z])|(?<![\w/.-])(?:[A-Z]-\d+|\d+/\d+)(?:-[A-Z])?)"
ADDRESS = re.compile(rf"{HOUSE}(?:,\s*{PART}){{1,7}}(?:(?:\s*[-–]\s*|,?\s*PIN\s*:?\s*|\s+|-)\d{{3}}\s?\d{{3}}(?!\d))?")
NAME_TOKEN = rf"(?:[A-Z][a-z]+(?:{BREAK}[a-z]+)?|[A-Z]\.|[A-Z]{{2,}}(?:{BREAK}[A-Z]+)?)"
NAME = rf"{NAME_TOKEN}(?:\s+{NAME_TOKEN}){{1,3}}"
HONORIFIC = r"(?:Mr|Mrs|Ms|Dr|Shri|Smt|Sh|Kum|Km|Sri|Prof|Miss|M/s)\.?"
#: What stands before a name: the cues of the sample's labels.
CUES = re.compile(
    rf"(?:\b{HONORIFIC}\s+|\b[SDWC]/o\.?\s+|\b(?i:wife|son|daughter|husband|widow|father|mother)\s+of\s+(?:late\s+)?|\bSd/-\s*|\baddressed\s+to\s+|\baccused\s+|[(]\d[)]\s*|\bPW-\d+\s+|\bDW-\d+\s+|\b(?:himself|herself)\s+as\s+|\bin\s+the\s+name\s+of\s+|\bnominee\s+|\bby\s+late\s+|\bfiled\s+by\s+|\bfavour\s+of\s+|\bdriver,\s+|\bcopy\s+to\s+|\bServed:\s+|\bdeponent\s+|\bshown\s+as\s+|\bthat\s+evening\s+|\bfactory\s+before\s+)({NAME})(?=[,.;()<\s]|$)"
)
ALONE = re.compile(rf"\bto\s+({NAME})\s+alone\b")
OFFICE = {"court", "department", "board", "council", "officer", "commissioner", "collector", "registrar", "authority", "tribunal", "bench", "commission", "appeal", "petition", "application", "judge", "bank", "corporation", "limited", "state", "union", "government", "advocate", "counsel", "chamber", "registry", "notice", "road", "street", "colony", "sector", "dist", "tal", "no", "learned", "the", "division", "high", "supreme", "single", "district", "municipal", "annexure", "section"}
TITLES = {"mr", "mrs", "ms", "dr", "shri", "smt", "sh", "kum", "km", "sri", "prof", "miss", "late"}
#: The first alternative is the last word class again, for words that plainly end; it only saves time.
TOKEN = re.compile(rf"[^\W\d_]+(?=[\s,;](?!\s?[@(\[]))|{EMAIL.pattern}|{PHONE.pattern}|{ID.pattern}|\+?\d[\d./,-]*\d|\d|[^\W\d_]+\d\w*|[^\W\d_]+(?:{BREAK}[^\W\d_]+)?(?:/[a-z])?|[^\w\s]|_")
SPLIT = re.compile(f"({TOKEN.pattern})")
BROKEN, DOUBLED = re.compile(BREAK), re.compile(r"(.)\1")
UNSEEN = "?"


def shape(token: str) -> str:
    """The class of a token no vocabulary holds: the notation it is whole, or its shape."""
    if re.search(r"@|\(at\)|\[at\]", token):
        return "@"
    t = BROKEN.sub("", token)
    if t.isalpha():
        if len(t) == 1:
            return "A" if t.isupper() else "a"
        return ("Xx" if t[0].isupper() and t[1:].islower() else "XX" if t.isupper() else "xx" if t.islower() else "xX") if t.isascii() else "ux"
    if len(t) > 20:
        return "long"
    if len(t) > 7:
        # notations apart by how they group, as far as that tells them from other numbers
        if ID.fullmatch(t):
            return f"id{re.sub('[0-9]+', '9', re.sub('[A-Z]', 'A', t))}"
        if PHONE.fullmatch(t):
            return f"phone{'+' if t[:2] in ('+9', '00') else '(' if t[0] == '(' else re.sub('[0-9]+', '9', t)}"
    s = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]", "A", re.sub(r"\s", "_", t)))
    if s.isdigit():
        return f"9{len(s)}" if len(s) < 13 else "9+"
    return re.sub(r"\d+", "9", s)


@dataclass
class Model:
    """Class numbers, whether a class opens a stretch to learn from, and the weights: ``w[k, class, label]`` for offsets -2..2, transitions, skip edges."""

    classes: dict[str, int]
    seed: np.ndarray
    w: np.ndarray
    trans: np.ndarray
    skip: float = 1.0


#: Which label may follow which: inside only behind its own kind.
ALLOWED = np.array([[0.0 if not b.startswith("I") or a[2:] == b[2:] and a != "O" else -1e4 for b in LABELS] for a in LABELS])
#: From labels to kinds (0: none).
KIND_OF = np.eye(len(KINDS) + 1, dtype=np.float32)[TYPE]
#: Letters that scans and hands exchange: tokens that differ in them alone are alike (fixed values).
CONFUSED = str.maketrans("0158|", "olsbl")


class Lexicon(dict):
    """Numbers the tokens met: their classes and roots are looked up by number; ``limit`` tokens are remembered.

    Tokens share a root if they may name the same thing: the same letters in any case,
    hyphenated or not, doubled or exchanged for letters that look alike or not.
    """

    def __init__(self, classes: dict[str, int], limit: int = 400_000):
        super().__init__()
        self.named, self.limit = classes, limit
        self.forget()

    def forget(self) -> None:
        """Starts anew."""
        self.clear()
        self.roots: dict[str, int] = {}
        self.class_of, self.root_of = array("i"), array("i")

    def __missing__(self, token: str) -> int:
        c = self.named
        plain = BROKEN.sub("", token)
        low = plain.lower()
        k = c.get(f"w:{low}:{'X' if token[0].isupper() else 'x'}")
        self.class_of.append(c.get("s:" + shape(token), c[UNSEEN]) if k is None else k)
        root = -1
        if len(low) > 3 and token[0].isupper() and plain.isalnum():
            key = DOUBLED.sub(r"\1", low.translate(CONFUSED).replace("rn", "m").replace("vv", "w"))
            root = self.roots.setdefault(key, len(self.roots))
        self.root_of.append(root)
        n = self[token] = len(self)
        return n

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """The numbers of a text's tokens."""
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


def overlaps(spans: list[tuple[int, int, str]], a: int, b: int) -> bool:
    """Whether a..b shares a character with one of the spans."""
    return any(a < y and x < b for x, y, _ in spans)


def silver(text: str) -> list[tuple[int, int, str]]:
    """Spans that cue patterns give: the labels of the sample."""
    out: list[tuple[int, int, str]] = []
    for kind, pattern in (("email", EMAIL), ("id_number", ID), ("phone", PHONE), ("address", ADDRESS)):
        for m in pattern.finditer(text):
            if not overlaps(out, *m.span()):
                out.append((*m.span(), kind))
    for pattern in (CUES, ALONE):
        for m in pattern.finditer(text):
            a, b = trim_name(text, *m.span(1))
            if a < b and not overlaps(out, a, b):
                out.append((a, b, "person"))
    return sorted(out)


def trim_name(text: str, a: int, b: int) -> tuple[int, int]:
    """A name's span without titles before it, and ended before the first word of an office or a sentence."""
    words = [(m.start() + a, m.end() + a, re.sub(r"\W", "", m[0]).lower()) for m in re.finditer(rf"[^\W\d_]+(?:{BREAK}[^\W\d_]+)?\.?", text[a:b])]
    while words and (words[0][2] in TITLES or not text[words[0][0]].isupper()):
        words = words[1:]
    keep = []
    for x, y, w in words[:4]:
        if w in OFFICE or not text[x].isupper():
            break
        if keep and (text[keep[-1][1] : x].strip() or "\n\n" in text[keep[-1][1] : x]):
            break
        if keep and text[keep[-1][1] - 1] == "." and keep[-1][1] - keep[-1][0] > 3:
            break
        keep.append((x, y, w))
    while keep and text[keep[-1][1] - 1] == "." and keep[-1][1] - keep[-1][0] > 2:
        keep[-1] = (keep[-1][0], keep[-1][1] - 1, keep[-1][2])
    if len(keep) < 2 or all(len(w) < 2 for _, _, w in keep):
        return (a, a)
    return (keep[0][0], keep[-1][1])


def tokens_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The tokens of a text, their starts and ends."""
    return placed(SPLIT.split(text))


def placed(parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, starts and ends of a text that is split into what stands between the tokens, and these, in turn."""
    at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return parts[1::2], at[:-1:2], at[1::2]


def zones(seeds: np.ndarray, n: int, reach: int = 8) -> list[tuple[int, int]]:
    """Stretches of tokens around the seeds, run together where they touch."""
    out: list[tuple[int, int]] = []
    for s in seeds.tolist():
        a, b = max(0, s - reach), min(n, s + reach + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def packs_of(begin: np.ndarray, length: np.ndarray, width: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of like lengths together: ``(place, chain)`` indices, which of them are real, and the lengths; about ``width`` places each."""
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        # as many as fit when padded to the longest, which may be a quarter longer than the first
        most = max(int(length[order[at]]) * 5 // 4, int(length[order[at]]) + 1)
        end = min(len(order), at + max(1, width // most), int(np.searchsorted(length[order], most, "right")))
        ids = order[at:end]
        t = np.arange(int(length[ids].max()))[:, None]
        yield begin[ids] + np.minimum(t, length[ids] - 1), t < length[ids], length[ids]
        at = end


def forward_backward(emit: np.ndarray, real: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log messages forward and backward of chains ``(place, chain, label)`` between tokens that are none, and each chain's log sum."""
    e = np.exp(trans)
    f, g = np.empty_like(emit), np.empty_like(emit)
    f[0] = emit[0] + trans[0]
    for i in range(1, len(emit)):
        m = f[i - 1].max(1, keepdims=True)
        f[i] = np.where(real[i][:, None], m + np.log(np.exp(f[i - 1] - m) @ e + 1e-30) + emit[i], f[i - 1])
    g[-1] = trans[:, 0]
    for i in range(len(emit) - 2, -1, -1):
        x = g[i + 1] + emit[i + 1]
        m = x.max(1, keepdims=True)
        g[i] = np.where(real[i + 1][:, None], m + np.log(np.exp(x - m) @ e.T + 1e-30), trans[:, 0])
    last = f[-1] + trans[:, 0]
    m = last.max(1)
    return f, g, m + np.log(np.exp(last - m[:, None]).sum(1))


def best_labels(emit: np.ndarray, real: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels ``(place, chain)`` of chains between tokens that are none."""
    score = emit[0] + trans[0]
    back = np.empty(emit.shape, np.int8)
    stay = np.arange(N, dtype=np.int8)
    for i in range(1, len(emit)):
        both = score[:, :, None] + trans
        on = real[i][:, None]
        back[i] = np.where(on, both.argmax(1), stay)
        score = np.where(on, both.max(1) + emit[i], score)
    out = np.empty(emit.shape[:2], np.int8)
    at = (score + trans[:, 0]).argmax(1)
    chain = np.arange(emit.shape[1])
    for i in range(len(emit) - 1, -1, -1):
        out[i] = at
        if i:
            at = back[i, chain, at]
    return out


def vocabulary(read: list[tuple], least: int) -> tuple[dict[str, int], np.ndarray]:
    """Classes from the sample: words in ``least`` texts, shapes, and which of them open stretches to learn from."""
    words: Counter[str] = Counter()
    inside: Counter[str] = Counter()
    shapes: Counter[str] = Counter()
    held: Counter[str] = Counter()
    for (tokens, starts, _), spans in read:
        begin = {a for a, _, _ in spans}
        seen = set()
        for t, a in zip(tokens, starts.tolist()):
            hit = any(x <= a < y for x, y, _ in spans)
            low = BROKEN.sub("", t).lower()
            if low.isalpha() or not low.isalnum() and len(low) < 4 and not any(c.isdigit() for c in low):
                key = f"w:{low}:{'X' if t[0].isupper() else 'x'}"
                if key not in seen:
                    seen.add(key)
                    words[key] += 1
                    inside[key] += hit
            s = "s:" + shape(t)
            shapes[s] += 1
            held[s] += a in begin or hit
    names = [UNSEEN, "<>", *sorted(w for w, n in words.items() if n >= least), *sorted(s for s, n in shapes.items() if n >= 3)]
    classes = {n: i for i, n in enumerate(names)}
    seed = np.zeros(len(names), bool)
    for n, i in classes.items():
        if n.startswith("w:"):
            seed[i] = inside[n] > 0.3 * words[n] and n.endswith("X")
        elif n.startswith("s:"):
            # shapes that stood in an entity one time in twenty
            seed[i] = held[n] > 0.05 * shapes[n] and n[2:] not in ("xx", "xX", "ux", "a", "A")
    seed[classes[UNSEEN]] = False
    for s in ("s:Xx", "s:XX", "s:@"):
        if s in classes:
            seed[classes[s]] = True
    return classes, seed


def fit(texts: list[str], *, least: int = 6, rounds: int = 16, rate: float = 0.12, decay: float = 1e-5, most: int = 3000, plain: int = 600) -> Model:
    """Weights by maximum likelihood (Adam, in batches of stretches of like lengths) from the silver labels of a sample of texts.

    Learned from are ``most`` stretches around classes that stand in entities, and ``plain`` of 24 tokens anywhere.
    """
    one_thread()
    read = [(tokens_of(t), silver(t)) for t in texts]
    classes, seed = vocabulary(read, least)
    lexicon, c = Lexicon(classes), len(classes)
    model = Model(classes, seed, np.zeros((5, c, N)), np.zeros((N, N)))
    flat, truth, near, far = [], [], [], []
    met: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    for (tokens, starts, ends), spans in read:
        ids = lexicon.numbers(tokens)
        cls = np.array(lexicon.class_of, np.int32)[ids] if len(ids) else np.zeros(0, np.int32)
        labels = np.zeros(len(tokens), np.int64)
        for a, b, kind in spans:
            hit = np.flatnonzero((starts < b) & (ends > a))
            if len(hit):
                labels[hit] = LABELS.index(f"I-{kind}")
                labels[hit[0]] = LABELS.index(f"B-{kind}")
        pads = np.full(2, classes["<>"], np.int32)
        flat += [pads, cls]
        truth += [np.zeros(2, np.int64), labels]
        met.append((np.array(lexicon.root_of, np.int32)[ids] if len(ids) else np.zeros(0, np.int32), TYPE[labels]))
        # stretches of many seeds (lists, coded data) would make long chains, and teach little
        near += [(at + 2 + a, b - a) for a, b in zones(np.flatnonzero(seed[cls]), len(cls)) if b - a <= 150]
        far += [(at + 2 + a, min(24, len(cls) - a)) for a in range(0, len(cls), 24)]
        at += len(cls) + 2
    chosen = near[:: max(1, -(-len(near) // most))] + far[:: max(1, -(-len(far) // plain))]
    if not chosen:
        return model
    flat, y = np.concatenate([*flat, np.full(2, classes["<>"], np.int32)]), np.concatenate(truth)
    # no stretch begins or ends inside an entity
    inside = np.append((y > 0) & (y % 2 == 0), False)
    chosen = [(a, n) for a, n in chosen if n and not inside[a] and not inside[a + n]]
    packs = [(idx, real) for idx, real, _ in packs_of(*np.array(chosen).T, 6_000)]
    params = [model.w, model.trans]
    moment = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    order = np.random.default_rng(7)
    steps = rounds * len(packs)
    for it in range(1, steps + 1):
        if it % len(packs) == 1 % len(packs):
            turn = order.permutation(len(packs))
        idx, real = packs[turn[(it - 1) % len(packs)]]
        total = int(real.sum())
        grads = [decay * total * p for p in params]
        trans = model.trans + ALLOWED
        emit = sum(model.w[k][flat[idx + k - 2]] for k in range(5))
        f, g, z = forward_backward(emit, real, trans)
        p = np.exp(f + g - z[:, None])
        chain = np.arange(idx.shape[1])
        diff = p[real]
        diff[np.arange(len(diff)), y[idx[real]]] -= 1.0
        for k in range(5):
            cls = flat[idx[real] + k - 2]
            grads[0][k] += np.bincount((cls[:, None] * N + np.arange(N)).ravel(), diff.ravel(), c * N).reshape(c, N)
        ends = real.sum(0) - 1
        grads[1][0] += p[0].sum(0)
        np.subtract.at(grads[1][0], y[idx[0]], 1.0)
        grads[1][:, 0] += p[ends, chain].sum(0)
        np.subtract.at(grads[1][:, 0], y[idx[ends, chain]], 1.0)
        # neighbours inside the chains, all at once
        on = real[1:]
        x1, x2 = f[:-1][on], (emit + g)[1:][on]
        m1, m2 = x1.max(1, keepdims=True), x2.max(1, keepdims=True)
        scale = np.exp(np.minimum(m1 + m2 - np.broadcast_to(z, on.shape)[on][:, None], 300.0))
        grads[1] += ((np.exp(x1 - m1) * scale).T @ np.exp(x2 - m2)) * np.exp(trans)
        np.subtract.at(grads[1], (y[idx[:-1][on]], y[idx[1:][on]]), 1.0)
        for p, gr, m, s in zip(params, grads, moment, second):
            gr /= total
            m += 0.1 * (gr - m)
            s += 0.01 * (gr * gr - s)
            p -= rate * (1.1 - it / steps) * (m / (1 - 0.9**it)) / (np.sqrt(s / (1 - 0.99**it)) + 1e-8)
    model.skip = skip_weight(met)
    return model


def skip_weight(met: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The potential of a skip edge: half the log odds ratio of neighbours among the like tokens of a text being of one kind, in the sample.

    That is its maximum likelihood in a model of pairs; one is added to each count. Cues name
    fewer places than there are, so it errs to the low side.
    """
    same, none, apart = 1.0, 1.0, 1.0
    for roots, kinds in met:
        on = np.flatnonzero(roots >= 0)
        on = on[np.argsort(roots[on], kind="stable")]
        a, b = kinds[on[:-1]], kinds[on[1:]]
        pair = roots[on[:-1]] == roots[on[1:]]
        same += np.count_nonzero(pair & (a == b) & (a > 0))
        none += np.count_nonzero(pair & (a == b) & (a == 0))
        apart += np.count_nonzero(pair & (a != b))
    return float(np.clip(0.5 * np.log(same * none / (apart / 2) ** 2), 0.0, 4.0))


class Finder:
    """Finds entities in batches of texts."""

    def __init__(self, model: Model):
        one_thread()
        self.model, self.lexicon = model, Lexicon(model.classes)
        self.trans = (model.trans + ALLOWED).astype(np.float32)
        self.w = model.w.astype(np.float32)
        # each offset's greatest gain of any label over none
        self.gain = (self.w[:, :, 1:].max(2) - self.w[:, :, 0]).astype(np.float32)
        # what a run of entities can gain by its transitions: by going on, and by its two ends together
        t = self.trans - self.trans[0, 0]
        self.onward = float(t[1:, 1:].max())
        self.ends = float(t[0, 1:].max() + t[1:, 0].max()) - self.onward

    def open_places(self, cls: np.ndarray, slack: float = 1.0) -> np.ndarray:
        """The places of ``cls`` that may hold an entity.

        In the best labels every run of entities scores more than none would at its places.
        A place is closed if no run over it can, even if each of its tokens had the label that
        gains most: the best labels of the whole chain have none there. Tested first
        by a bound of one number a class, then by the scores.
        """
        n = len(cls) - 4
        gain = self.gain[0][cls[:n]].astype(np.float64)
        for k in range(1, 5):
            gain += self.gain[k][cls[k : n + k]]
        pad = cls[2:-2] == self.model.classes["<>"]
        gain[pad] = -1e6
        at = np.flatnonzero(self.best_run(gain) > -slack) + 2
        score = self.emission(cls, at)
        exact = np.full(n, -1e6)
        exact[at - 2] = score[:, 1:].max(1) - score[:, 0]
        return np.flatnonzero(self.best_run(exact) > -slack) + 2

    def best_run(self, gain: np.ndarray) -> np.ndarray:
        """For each place the most that a run over it can gain."""
        gain = gain + self.onward
        total = np.append(0.0, np.cumsum(gain))
        left = np.minimum.accumulate(total)[:-1]
        right = np.maximum.accumulate(total[::-1])[::-1][1:]
        return right - left + self.ends

    def emission(self, cls: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The label scores of the places ``at``, from the classes two before to two behind."""
        out = self.w[0][cls[at - 2]]
        for k in range(1, 5):
            out += self.w[k][cls[at + k - 2]]
        return out

    def beliefs(self, score: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The marginals over kinds of all places of the chains ``begin``, ``length``; elsewhere none."""
        out = np.zeros((len(score), len(KINDS) + 1), np.float32)
        out[:, 0] = 1.0
        for idx, real, _ in packs_of(begin, length):
            f, g, z = forward_backward(score[idx], real, self.trans)
            out[idx[real]] = (np.exp(f + g - z[:, None]) @ KIND_OF)[real]
        return out

    def decode(self, cls: np.ndarray, roots: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in order and their labels, for the texts of a batch set one behind the other with two pads between."""
        at = self.open_places(cls)
        if not len(at):
            return at, np.zeros(0, np.int8)
        score, (begin, length) = self.emission(cls, at), runs(at)
        # the groups of alike tokens of a text
        on = np.flatnonzero(roots >= 0)
        key = text_of[on].astype(np.int64) * (int(roots.max()) + 1) + roots[on]
        order = np.argsort(key, kind="stable")
        on, key = on[order], key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        many = np.repeat(size > 1, size)
        on, size = on[many], size[size > 1]
        heard = np.zeros((len(at), len(KINDS) + 1), np.float32)
        if len(on):
            start = np.cumsum(size) - size
            belief = self.beliefs(score, *touched(at, on, begin, length))
            mine = np.full((len(on), len(KINDS) + 1), [1.0, *[0.0] * len(KINDS)], np.float32)
            here, found = where_of(at, on)
            mine[found] = belief[here[found]]
            # places that hear of an entity are open, too, with those around them
            told = np.repeat(np.add.reduceat(1 - mine[:, 0], start) > 0.02, size)
            more = np.unique((on[told & ~found][:, None] + np.arange(-6, 7)).ravel())
            more = more[(more >= 0) & (more < len(cls))]
            more = more[text_of[more] >= 0]
            if len(more):
                at = np.union1d(at, more)
                score, (begin, length) = self.emission(cls, at), runs(at)
                heard = np.zeros((len(at), len(KINDS) + 1), np.float32)
                here, found = where_of(at, on)
            on, here, found = on[told], here[told], found[told]
            mine, size = mine[told], size[np.add.reduceat(told, start) > 0] if len(told) else size
            start = np.cumsum(size) - size
            chains = touched(at, on, begin, length)
            for again in range(2):
                if not len(on):
                    break
                if again:
                    # what a place told is what it believes without what it was told
                    belief = self.beliefs(score + heard[:, TYPE], *chains)[here] * np.exp(-heard[here])
                    mine = belief / belief.sum(1, keepdims=True)
                says = np.log1p((np.exp(np.float32(self.model.skip)) - 1) * mine)
                says[:, 0] = 0.0
                rest = np.repeat(np.add.reduceat(says, start), size, axis=0) - says
                heard[here] = rest / np.sqrt(np.repeat(size - 1, size))[:, None]
        label = np.zeros(len(at), np.int8)
        score = score + heard[:, TYPE]
        for idx, real, _ in packs_of(begin, length):
            label[idx[real]] = best_labels(score[idx], real, self.trans)[real]
        return at, label

    def labels(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The spans of each text: chains first, then messages along skip edges, then the best labels."""
        lexicon, pad = self.lexicon, self.model.classes["<>"]
        if len(lexicon) > lexicon.limit:
            lexicon.forget()
        split = [SPLIT.split(t) for t in texts]
        numbers = [lexicon.numbers(p[1::2]) for p in split]
        sizes = np.array([len(n) for n in numbers], np.int64)
        offset = np.cumsum(sizes + 2) - sizes
        total = int(sizes.sum()) + 2 * len(texts) + 2
        text_of = np.full(total, -1, np.int32)
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        where = np.arange(len(flat)) + 2 * (np.repeat(np.arange(len(texts)), sizes) + 1)
        cls, roots = np.full(total, pad, np.int32), np.full(total, -1, np.int32)
        cls[where], roots[where] = np.array(lexicon.class_of, np.int32)[flat], np.array(lexicon.root_of, np.int32)[flat]
        text_of[where] = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        at, label = self.decode(cls, roots, text_of)
        at, label = at[label > 0], label[label > 0].astype(np.int64)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(at):
            return out
        opens = np.append(True, (at[1:] != at[:-1] + 1) | (label[1:] % 2 == 1))
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(at)) - 1
        place: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d, i, j, k in zip(text_of[at[first]].tolist(), at[first].tolist(), at[last].tolist(), label[first].tolist()):
            if d not in place:
                place[d] = placed(split[d])[1:]
            starts, ends = place[d]
            out[d].append((int(starts[i - offset[d]]), int(ends[j - offset[d]]), KINDS[TYPE[k] - 1]))
        return [checked(t, spans) for t, spans in zip(texts, out)]


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of adjoining places begin in ``at``, and how long they are."""
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    return begin, np.diff(np.append(begin, len(at)))


def where_of(at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each place in ``at``, and whether it is there."""
    i = np.minimum(np.searchsorted(at, places), len(at) - 1)
    return i, at[i] == places


def touched(at: np.ndarray, places: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chains that hold one of the places."""
    i, found = where_of(at, places)
    ids = np.unique(np.searchsorted(begin, i[found], "right") - 1)
    return begin[ids], length[ids]


EXACT = {"email": EMAIL, "phone": PHONE, "id_number": ID, "address": ADDRESS}


def checked(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans with exact ends: what doesn't hold a whole email, number, address or name of its kind is no case."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[2] == "person", s[0])):
        if kind == "person":
            x, y = trim_name(text, a, b)
            ok = x < y
        else:
            # the whole notation that shares most with the span
            best = 0
            for m in EXACT[kind].finditer(text, max(0, a - 60)):
                if m.start() >= b:
                    break
                if (shared := min(b, m.end()) - max(a, m.start())) > best:
                    best, (x, y) = shared, m.span()
            ok = best > 0
        if ok and not overlaps(out, x, y):
            out.append((x, y, kind))
    return sorted(out)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by a placeholder of its kind."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def sample_texts(texts: DataFrame, size: int) -> list[str]:
    """About ``size`` texts (of 30 to 6,000 characters), those with the lowest hashes of their ids; no more comes to the driver.

    The bound of the hashes is set by counting the texts.
    """
    rows = texts.where("length(_t) between 30 and 6000").select("_t", F.xxhash64("_id", F.lit(3)).alias("_h"))
    bound = int(-(2**63) + 2**64 * min(1.0, size / max(1, rows.count())))
    return [r["_t"] for r in rows.where(F.col("_h") < F.lit(min(bound, 2**63 - 1))).orderBy("_h", "_t").collect()]


def _run(model: Model, masked: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(model)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                texts = [t if isinstance(t, str) else "" for t in part["_t"]]
                found = finder.labels(texts)
                if masked:
                    out = [(o, i, None if not isinstance(raw, str) else mask(t, s), len(s)) for o, i, raw, t, s in zip(part["_o"], part["_id"], part["_t"], texts, found)]
                    yield pd.DataFrame(out, columns=["origin", "row_id", "text", "n_masked"])
                else:
                    out = [(o, i, k, t[a:b]) for o, i, t, s in zip(part["_o"], part["_id"], texts, found) for a, b, k in s]
                    yield pd.DataFrame(out, columns=["origin", "row_id", "pii_type", "pii_text"])

    return run


def sources(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """The texts of both tables: ``_o`` origin, ``_id`` row id, ``_t`` text."""
    a = chunks.select(F.lit("chunks").alias("_o"), F.col("record_id").alias("_id"), F.col("chunk_text").alias("_t"))
    b = evidence.select(F.lit("finding_evidence").alias("_o"), F.col("evidence_id").cast("string").alias("_id"), F.col("quote").alias("_t"))
    return a.unionByName(b)


def personal_information(chunks: DataFrame, evidence: DataFrame, *, sample: int = 2500) -> DataFrame:
    """Rows ``(origin, row_id, pii_type, pii_text)``, one per distinct case; the model is fitted on ``sample`` texts."""
    texts = sources(chunks, evidence)
    model = fit(sample_texts(texts, sample))
    return spread(texts.where("_t is not null and _t <> ''")).mapInPandas(_run(model, False), "origin string, row_id string, pii_type string, pii_text string").distinct()


def masked(chunks: DataFrame, evidence: DataFrame, *, sample: int = 2500) -> DataFrame:
    """Rows ``(origin, row_id, text, n_masked)``: the texts with placeholders; null texts stay null, repeated rows repeat."""
    texts = sources(chunks, evidence)
    model = fit(sample_texts(texts, sample))
    return spread(texts).mapInPandas(_run(model, True), "origin string, row_id string, text string, n_masked int")
