"""Personal data: plain patterns, and candidates beyond them that boosted trees accept.

Plain patterns find e-mail addresses, IP addresses, card numbers and telephone numbers. Generators with high recall
then propose further, overlapping spans: written-out addresses, dotted or bracketed numbers, numbers without a plus
sign, valid parts of longer rows of digits. Gradient-boosted trees score each by its format and its context, and those
above their kind's threshold that meet no other span are taken, the best first.

No table says what is personal data, so the trees learn from plain matches of a bounded sample of documents and from
made-up values, all written anew in many forms and set into stretches of the sample's own text; decoys of the same
looks (dates, prices, versions, numbers with wrong check digits, parts of a value) are their opposite. A part of these
examples is kept aside to choose each kind's threshold by precision.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Bounds of the learning sample: documents, and stretches of their texts in which examples are set.
MOST_SAMPLED, MOST_STRETCHES = 2000, 1500
#: Least precision, on examples kept aside, of what a threshold lets pass.
PRECISION = 0.99
TREES, DEPTH, BINS, RATE = 80, 4, 32, 0.2
#: Characters read on each side of a candidate.
AROUND = 32
#: Digit runs in one candidate, and candidates scored at once.
MOST_RUNS, SCORED = 6, 20_000

_DIGITS = re.compile("[0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done, EMAIL
        at = text.find("@", done)


def _linked(text: str, runs: list[tuple[int, int]], between) -> list[list[tuple[int, int]]]:
    """Runs of digits in the longest chains whose gaps all satisfy `between`."""
    chains: list = []
    for run in runs:
        if chains and between(text[chains[-1][-1][1] : run[0]] if run[0] - chains[-1][-1][1] <= 8 else ""):
            chains[-1].append(run)
        else:
            chains.append([run])
    return chains


def plain_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """(start, end, kind) of the patterns' matches that are valid, by start, then kind.

    Each kind's matches are the leftmost that don't overlap; a match that fails its check is passed over whole. All is
    read once, whatever the text: the digits of a match are whole runs of digits, an address is found from its at sign.
    """
    runs = [m.span() for m in _DIGITS.finditer(text)] if runs is None else runs
    found = list(_emails(text))
    for chain in _linked(text, runs, ".".__eq__):
        for i in range(0, len(chain) - 3, 4):
            if all(is_octet(text[a:b]) for a, b in chain[i : i + 4]):
                found.append((chain[i][0], chain[i + 3][1], IP))
    for chain in _linked(text, runs, lambda gap: gap in (" ", "-")):
        if 12 <= sum(b - a for a, b in chain) <= 19 and luhn("".join(text[a:b] for a, b in chain)):
            found.append((chain[0][0], chain[-1][1], CARD))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), PHONE))
    return sorted(found, key=lambda s: (s[0], s[2]))


# -- candidates

_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s(?:dot|DOT|punkt|punto|point)\s)"
_AT = re.compile(r"[@＠]|&#64;|%40|(?<![A-Za-z])(?:at|AT|arroba|arobase)(?![A-Za-z])")
_AFTER_AT = re.compile(r"\s{0,2}[\])}]?\s{0,2}([A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){1,5})")
_BEFORE_AT = re.compile(r"([A-Za-z0-9_%+-]{1,64}(?:" + _DOT + r"[A-Za-z0-9_%+-]{1,64}){0,3})(\s{0,2}[\[({]?\s{0,2})\Z")
_HEXES = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_LOOSE = re.compile(r"[\s().\-/·_]{1,3}")
_DOTTED = re.compile(r"\.|\s?\.\s?|\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\s(?:dot|DOT)\s")


def candidates(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """Overlapping spans that may be personal data, most of which are not. Linear in the text: each chain of digit runs
    gives at most MOST_RUNS spans a run and kind."""
    runs = [m.span() for m in _DIGITS.finditer(text)] if runs is None else runs
    found = set()
    for m in _AT.finditer(text):
        left = _BEFORE_AT.search(text, max(0, m.start() - 72), m.start())
        right = _AFTER_AT.match(text, m.end()) if left else None
        if right:
            found.add((left.start(1), right.end(1), EMAIL))
            short = re.search(r"[A-Za-z0-9_%+-]+\Z", left[1])
            found.add((left.start(1) + short.start(), right.end(1), EMAIL))
    if ":" in text:
        found |= {(*m.span(), IP) for m in _HEXES.finditer(text) if len(m[0]) >= 3}
    for chain in _linked(text, runs, _DOTTED.fullmatch):
        for i in range(len(chain) - 3):
            if all(is_octet(text[a:b]) for a, b in chain[i : i + 4]):
                found.add((chain[i][0], chain[i + 3][1], IP))
    for chain in _linked(text, runs, _LOOSE.fullmatch):
        for i in range(len(chain)):
            start, n = chain[i][0], 0
            for a, b in chain[i : i + MOST_RUNS]:
                n += b - a
                if n > 19:
                    break
                if 12 <= n and luhn("".join(filter(str.isdigit, text[start:b]))):
                    found.add((start, b, CARD))
                if 7 <= n <= 15:
                    first = start
                    if first and text[first - 1] == "(":
                        first -= 1
                    if first and text[first - 1] == "+":
                        first -= 1
                    found.add((first, b, PHONE))
    return sorted(found)


# -- features

_CUES = tuple(
    re.compile(p)
    for p in (
        r"e-?mails?|courriel|correo|mail(?:to)?|contact|write|reach",
        r"\bip\b|ipv[46]|host|server|addr|address|adresse|direcci|from",
        r"card|carte|karte|tarjeta|visa|master|amex|credit|kredit|payment|pay",
        r"tel|phone|fon|call|mobil|fax|whatsapp|sms|dial|ring",
        r"isbn|issn|order|invoice|version|\bv\b|\bid\b|ref|total|page|no\.|nr\.|n°|#|build|release|serial|code|date|year|[$€£%=]",
    )
)
_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (3, 3, 4), (3, 4), (2, 2, 2, 2, 2))


class Features(NamedTuple):
    """What a candidate looks like, and what stands around it."""

    kind: float
    length: float
    digits: float
    runs: float
    longest: float
    shortest: float
    luhn: float
    lead: float
    zero_first: float
    plus: float
    bracket: float
    spaces: float
    hyphens: float
    dots: float
    slashes: float
    mixed: float
    grouping: float
    octets: float
    smallest_octet: float
    colons: float
    at_sign: float
    at_bracket: float
    dot_word: float
    labels: float
    last_label: float
    local: float
    upper: float
    before: float
    after: float
    more_before: float
    more_after: float
    date: float
    cue_email: float
    cue_ip: float
    cue_card: float
    cue_phone: float
    cue_other: float


def _side(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c in ".,;:!?" else 2.0 if c in "()[]{}<>\"'" else 3.0 if c.isalpha() else 4.0 if c.isdigit() else 5.0


def features(text: str, span: Span) -> Features:
    start, end, kind = span
    value, left, right = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    runs = _DIGITS.findall(value)
    digits, sizes = "".join(runs), tuple(map(len, runs)) or (0,)
    seps = {c for c in value if not c.isalnum()}
    octets = [int(r) if len(r) <= 4 else 9999 for r in runs]
    labels = re.split(_DOT, re.split(_AT, value)[-1]) if kind == EMAIL else []
    last = labels[-1].strip() if labels else ""
    near = left.lower()
    year = len(runs) >= 3 and sizes[:3] in ((4, 2, 2), (2, 2, 4), (1, 2, 4), (2, 1, 4), (1, 1, 4), (4, 1, 1), (4, 1, 2), (4, 2, 1))
    return Features(
        kind, len(value), len(digits), len(runs), max(sizes), min(sizes), bool(digits) and luhn(digits), int(digits[0]) if digits else -1, digits[:1] == "0", value[:1] == "+", any(c in "()[]{}" for c in value),
        sum(map(str.isspace, value)), value.count("-"), value.count("."), value.count("/"), len(seps), next((i + 1.0 for i, g in enumerate(_GROUPS) if sizes[-len(g) :] == g), 0.0),
        bool(octets) and max(octets) <= 255, min(octets, default=-1), value.count(":"), any(c in value for c in "@＠%&"), bool(re.search(r"[\[({]\s?(?:at|AT|@)", value)), bool(re.search(r"dot|DOT|punkt|punto|point", value)),
        len(labels), len(last) if last.isalpha() and last.islower() else -1.0, len(re.split(_AT, value)[0].strip(" [({")) if kind == EMAIL else 0, sum(map(str.isupper, value)),
        _side(left[-1:]), _side(right[:1]), bool(re.search(r"[A-Za-z0-9]" + _DOT + r"\Z", left) if kind == EMAIL else re.search(r"[0-9][\s().\-/:_]{0,2}\Z", left)), bool(re.match(r"[\s().\-/:_]{0,2}[0-9]", right)), year,
        *(bool(cue.search(near)) for cue in _CUES),
    )


# -- boosted trees

class Trees:
    """Gradient-boosted trees of one depth under the logistic loss, on binned features."""

    def __init__(self, cuts: list[np.ndarray], splits: np.ndarray, values: np.ndarray, base: float):
        self.cuts, self.splits, self.values, self.base = cuts, splits, values, base

    @staticmethod
    def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
        cuts = []
        for column in x.T:
            values = np.unique(column)
            middle = (values[1:] + values[:-1]) / 2
            cuts.append(middle if len(middle) < BINS else np.unique(middle[np.linspace(0, len(middle) - 1, BINS - 1).astype(int)]))
        b, width = cls.binned(x, cuts), BINS + 1
        n, m = b.shape
        share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        f, splits, values = np.full(n, base), [], []
        flat = b + width * np.arange(m)
        for _ in range(trees if n else 0):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(n, np.int64), np.zeros(((1 << depth) - 1, 2), np.int64)
            for level in range(depth):
                size, first = 1 << level, (1 << level) - 1
                at = (node[:, None] * (m * width) + flat).ravel()
                sums = [np.bincount(at, np.repeat(w, m), size * m * width).reshape(size, m, width) for w in (g, h)]
                low_g, low_h = (s.cumsum(2) for s in sums)
                all_g, all_h = low_g[:, :1, -1:], low_h[:, :1, -1:]
                gain = low_g**2 / (low_h + 1) + (all_g - low_g) ** 2 / (all_h - low_h + 1)
                gain[(low_h < 1) | (all_h - low_h < 1)] = -1
                best = gain.reshape(size, -1).argmax(1)
                tree[first : first + size] = np.stack(np.divmod(best, width), 1)
                j, cut = tree[first + node].T
                node = 2 * node + (b[np.arange(n), j] > cut)
            leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            f += leaf[node]
            splits.append(tree)
            values.append(leaf)
        return cls(cuts, np.array(splits, np.int64).reshape(-1, (1 << depth) - 1, 2), np.array(values).reshape(-1, 1 << depth), base)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance that each row is a case."""
        b, f, rows = self.binned(x, self.cuts), np.full(len(x), self.base), np.arange(len(x))
        depth = self.values.shape[1].bit_length() - 1
        for tree, leaf in zip(self.splits, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                j, cut = tree[(1 << level) - 1 + node].T
                node = 2 * node + (b[rows, j] > cut)
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


# -- examples

def _grouped(digits: str, sizes, sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(p for p in [*out, digits[at:]] if p)


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng, valid: bool = True) -> str:
    digits = str(rng.choice(["4", "51", "55", "37", "6011", "2221"]))
    digits += _number(rng, (14 if digits == "37" else 15) - len(digits))
    check = next(d for d in "0123456789" if luhn(digits + d))
    return digits + (check if valid else str((int(check) + int(rng.integers(1, 10))) % 10))


def written(rng, kind: int, value: str) -> str:
    """A personal value in one of the ways in which people write it."""
    pick = lambda *options: str(options[rng.integers(len(options))])
    if kind == EMAIL:
        local, _, domain = value.partition("@")
        dot = pick(".", ".", " dot ", " [dot] ", "[.]", "(dot)")
        at = pick(" [at] ", "[at]", " (at) ", "(at)", " at ", "[@]", "&#64;", "＠", " @ ") if dot == "." else pick(" [at] ", "[at]", "(at)", " at ", " AT ", "@")
        return local.replace(".", dot if rng.random() < 0.5 else ".") + at + domain.replace(".", dot)
    if kind == IP:
        if rng.random() < 0.25:
            return ":".join(f"{int(g):x}" for g in rng.integers(0, 65536, 8)) if rng.random() < 0.6 else f"{pick('fe80', '2001:db8')}::{int(rng.integers(1, 65536)):x}:{int(rng.integers(1, 65536)):x}"
        return value.replace(".", pick("[.]", "(.)", " . ", " dot ", "[dot]", ".", "."))
    digits = "".join(filter(str.isdigit, value))
    if kind == CARD:
        sep = pick(" ", "-", ".", "/", "  ", " - ", "_")
        return _grouped(digits, (4, 6, 5) if len(digits) == 15 else (4, 4, 4, 4), sep) if rng.random() < 0.8 else digits
    area, middle, end = digits[-10:-7], digits[-7:-4], digits[-4:]
    sep = pick("-", ".", " ")
    return pick(f"({area}) {middle}-{end}", f"{area}{sep}{middle}{sep}{end}", f"1{sep}{area}{sep}{middle}{sep}{end}", f"00{digits[:-10] or 1} {area} {middle} {end}", f"0{area[1:]} {middle}{end}", f"0{area[:2]} {middle}{area[:1]} {end}", f"({area}){middle}{sep}{end}", f"0{area[:2]}/{middle}{end}", f"+{digits[:-10] or 1}/{area}/{middle}-{end}")


def decoy(rng, words: list[str]) -> str:
    """Something with digits or an `at` that isn't personal."""
    k = rng.integers(13)
    y, m, d = rng.integers(1900, 2100), rng.integers(1, 13), rng.integers(1, 29)
    if k == 0:
        return [f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{y}{m:02}{d:02}"][rng.integers(4)]
    if k == 1:
        return f"{y}-{m:02}-{d:02} {rng.integers(24):02}:{rng.integers(60):02}:{rng.integers(60):02}"
    if k == 2:
        return f"{rng.choice(['$', '€', '£', ''])}{rng.integers(1, 1000)}{rng.choice([',', '.', ' '])}{_number(rng, 3)}{rng.choice(['.00', ',50', '', '.99'])}"
    if k == 3:
        return ".".join(map(str, rng.integers(0, 30, rng.integers(2, 7))))
    if k == 4:
        return _grouped(_card(rng, False), (4, 4, 4, 4), str(rng.choice(["", " ", "-", "."])))
    if k == 5:
        return _number(rng, int(rng.integers(5, 24)))
    if k == 6:
        return f"978-{_number(rng, 1)}-{_number(rng, 4)}-{_number(rng, 4)}-{_number(rng, 1)}"
    if k == 7:
        return " ".join(_number(rng, int(n)) for n in rng.integers(1, 6, rng.integers(2, 9)))
    if k == 8:
        return f"{rng.integers(0, 181)}.{_number(rng, 6)}, {rng.integers(0, 91)}.{_number(rng, 6)}"
    if k == 9:
        return ".".join(map(str, rng.integers(200, 999, 4)))
    if k == 10:
        return f"pages {rng.integers(1, 999)}-{rng.integers(1, 9999)} ({y})"
    if k == 11:
        word = lambda: str(words[rng.integers(len(words))])
        left = word() if rng.random() < 0.7 else f"{y}-{m:02}-{d:02}" if rng.random() < 0.5 else str(y)
        return f"{left} {rng.choice(['at', 'at', '@'])} {word()}.{word().capitalize() if rng.random() < 0.7 else _number(rng, int(rng.integers(1, 5)))}"
    return f"{rng.integers(24):02}:{rng.integers(60):02}:{rng.integers(60):02}"


def made_up(rng, kind: int, words: list[str]) -> str:
    if kind == EMAIL:
        word = lambda: str(words[rng.integers(len(words))])
        end = ["", f".{word()[:1]}", str(rng.integers(0, 100)), f"_{word()}", f".{word()}"][rng.integers(5)]
        return f"{word()}{end}@{word()}{['', rng.integers(0, 10)][rng.integers(2)]}.{['example.com', 'org', 'de', 'net', 'co.uk', 'fr', 'com', 'com', 'info', 'io', 'edu'][rng.integers(11)]}"
    if kind == IP:
        return ".".join(map(str, rng.integers(0, 256, 4)))
    return _card(rng) if kind == CARD else f"+{rng.integers(1, 99)} {rng.integers(200, 999)} {_number(rng, 3)} {_number(rng, 4)}"


_SAID = (("e-mail: ", "contact ", "write to "), ("IP ", "host ", "server at "), ("card ", "Visa: ", "paid with "), ("tel. ", "call ", "phone: "))
_SAID_OTHER = ("", "ISBN ", "order no. ", "version ", "ref ", "total ", "id=", "on ", "#")


class Stretch(NamedTuple):
    """A place in a text where an example is set, and the plain match that stands there, if any."""

    left: str
    right: str
    kind: int
    value: str | None


def stretches(text: str, seed: int) -> list[Stretch]:
    """Up to four plain matches of the text, and two places before words, all of them drawn from the whole text."""
    rng = np.random.default_rng(seed)
    spans, words = plain_spans(text), [m.start() for m in re.finditer(r"(?<=\s)\S", text)]
    chosen = [spans[i] for i in sorted(rng.choice(len(spans), min(4, len(spans)), replace=False))] if spans else []
    places = sorted(rng.choice(words, min(2, len(words)), replace=False).tolist()) if words else []
    return [Stretch(text[max(0, a - AROUND) : a], text[b : b + AROUND], k, text[a:b][:200]) for a, b, k in chosen] + [Stretch(text[max(0, at - AROUND) : at], text[at - 1 : at + AROUND], int(rng.integers(4)), None) for at in places]


def examples(found: list[Stretch], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and marks (1: personal) of candidates set into the stretches."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    known = [w for s in found for w in re.findall(r"(?<![^\s])[a-z]{2,12}(?=[\s.,])", s.left + s.right)] or ["ann", "office", "home"]
    order = rng.permutation(len(found)).tolist()[:MOST_STRETCHES]
    places = [found[i] for i in order] + [Stretch("", "", kind, None) for kind in range(4)] * 8

    def put(left: str, value: str, right: str, kind: int | None) -> None:
        text = left + value + right
        a, b = len(left), len(left) + len(value)
        for s in candidates(text):
            if s[0] < b and s[1] > a:
                x.append(features(text, s))
                y.append(float(kind is not None and s == (a, b, kind)))

    for left, right, kind, value in places:
        for source in (value, made_up(rng, kind, known), made_up(rng, kind, known)):
            if source is not None:
                said = str(rng.choice(_SAID[kind])) if rng.random() < 0.3 else ""
                said_next = f" {rng.integers(1, 13):02}{rng.choice(['/', '-', ''])}{_number(rng, 2)}" if kind == CARD and rng.random() < 0.3 else f" {_number(rng, 3)}" if kind == CARD and rng.random() < 0.2 else ""
                put(left + said, written(rng, kind, source), said_next + right, kind)
        for _ in range(3):
            put(left + (str(rng.choice(_SAID_OTHER)) if rng.random() < 0.5 else ""), decoy(rng, known), right, None)
    return np.array(x, np.float64).reshape(-1, len(Features._fields)), np.array(y)


def threshold(scores: np.ndarray, y: np.ndarray, least: float = PRECISION) -> float:
    """The lowest score from which on `least` of the examples are cases; above 1 if there is none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True)[: len(y)]  # equal scores pass together
    good = np.flatnonzero((right >= least) & last)
    return float(scores[order][good[-1]]) if len(good) and y[order[: good[-1] + 1]].any() else 2.0


class Model(NamedTuple):
    trees: Trees
    thresholds: np.ndarray  #: by kind


def learnt(found: list[Stretch]) -> Model:
    x, y = examples(found)
    aside = np.arange(len(y)) % 3 == 0
    trees = Trees.fit(x[~aside], y[~aside])
    p = trees.scores(x[aside])
    return Model(trees, np.array([threshold(p[x[aside, 0] == k], y[aside][x[aside, 0] == k]) for k in range(len(KINDS))]))


STRETCH = pa.struct([("left", pa.string()), ("right", pa.string()), ("kind", pa.int64()), ("value", pa.string())])


def fit(docs: DataFrame) -> Model:
    """Learn from MOST_SAMPLED documents at most, chosen by a hash of their ids; null texts and ids are passed over,
    of a repeated doc_id the least text counts. Without documents the examples have no context."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_SAMPLED)
    # MOST_SAMPLED ids at most: broadcast by that bound
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            found = [[s._asdict() for s in stretches(t or "", d & 0xFFFFFFFF)] for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(STRETCH))], names=["doc_id", "found"])

    # six stretches a document at most
    drawn = sample.mapInArrow(run, "doc_id long, found array<struct<left:string,right:string,kind:long,value:string>>").orderBy("doc_id").collect()
    return learnt([Stretch(*s) for r in drawn for s in r.found])


def added(plain: list[Span], proposed: list[Span], scores: np.ndarray, thresholds: np.ndarray) -> list[tuple[Span, float]]:
    """The proposals that pass, best first, and meet neither a plain span nor a better one."""
    taken: list[tuple[int, int]] = sorted((a, b) for a, b, _ in plain)
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    starts = [a for a, _ in taken]
    passed = [(-p, a - b, (a, b, k)) for (a, b, k), p in zip(proposed, scores.tolist(), strict=True) if p >= thresholds[k]]
    out, chosen = [], []
    for p, _, s in sorted(passed):
        i = bisect_left(starts, s[1])
        j = bisect_left(chosen, (s[1],))
        if (i and reach[i - 1] > s[0]) or (j and chosen[j - 1][1] > s[0]):
            continue
        insort(chosen, s)
        out.append((s, -p))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("score", pa.float64())])
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,plain:boolean,score:double>>"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the spans of personal data in each whole text (code points, end exclusive), by start, then kind.

    `plain` spans come from the patterns (score 1), the others from the trees. A row for each row of docs; a null or empty text
    has no spans, null and repeated doc_ids stay; other columns of docs are not read. Equal scores: the longer span
    first, then the earlier, then the kind as listed.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 100 kB: TREES trees of one depth

    def run(batches):
        trees, thresholds = held.value
        for batch in batches:
            ids, texts, a = batch.column(0), batch.column(1), 0
            while a < batch.num_rows:
                plain, proposed, rows, b = [], [], [], a
                while b < batch.num_rows and len(rows) < SCORED:
                    text = texts[b].as_py() or ""
                    runs = [m.span() for m in _DIGITS.finditer(text)]
                    plain.append(plain_spans(text, runs))
                    met = _free(candidates(text, runs), plain[-1])
                    proposed.append(met)
                    rows += [features(text, s) for s in met]
                    b += 1
                scores = trees.scores(np.array(rows, np.float64)) if rows else np.zeros(0)
                out, at = [], 0
                for i, met in enumerate(proposed):
                    more = added(plain[i], met, scores[at : at + len(met)], thresholds)
                    at += len(met)
                    spans = [(*s, True, 1.0) for s in plain[i]] + [(*s, False, p) for s, p in more]
                    out.append([{"kind": KINDS[k], "start": x, "end": y, "plain": base, "score": p} for x, y, k, base, p in sorted(spans, key=lambda s: (s[0], s[2], s[1]))])
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(out, pa.list_(SPAN))], names=["doc_id", "spans"])
                a = b

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _free(spans: list[Span], plain: list[Span]) -> list[Span]:
    """Of spans in order, those that meet no plain one."""
    if not plain:
        return spans
    edges = sorted((a, b) for a, b, _ in plain)
    joined = [list(edges[0])]
    for (_, _), (a, b) in pairwise(edges):
        if a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, i = [], 0
    for s in spans:
        while i < len(joined) and joined[i][1] <= s[0]:
            i += 1
        if i == len(joined) or joined[i][0] >= s[1]:
            out.append(s)
    return out


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[{}]") -> DataFrame:
    """doc_id and the text with each span replaced by its kind; spans that overlap are replaced together, by the first's kind.

    Rows are matched by doc_id, which has to be unique; a text without spans, a null one and one without id stay.
    """
    spans = found.select(F.col("doc_id"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(spans, "doc_id", "left")
    at, text = F.struct(F.lit(0).cast("long").alias("upto"), F.lit("").alias("out")), F.col("text")
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    head, tail = mark.split("{}")

    def step(acc, s):
        new = F.concat(acc["out"], piece(acc["upto"], s["start"]), F.lit(head), s["kind"], F.lit(tail))
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), F.when(s["start"] >= acc["upto"], new).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.coalesce("spans", F.array()), at, step, lambda acc: F.concat(acc["out"], piece(acc["upto"], F.length(text).cast("long"))))
    return rows.select("doc_id", F.when(text.isNull(), text).otherwise(clean).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of plain spans by kind, their hash, and all spans as kind:start:end."""
    plain = F.filter("spans", lambda s: s["plain"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(plain).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
