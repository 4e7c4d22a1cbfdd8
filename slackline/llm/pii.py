"""Personal data: base patterns, and candidates that boosted trees select.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. High-recall generators propose
further, overlapping spans: written-out addresses, every run of digit groups in the lengths of phones and cards,
bracketed or spaced dotted quads, and secrets (what is assigned to names such as token, and long mixed words).
Gradient-boosted trees score each by its format and its context; a threshold by kind, calibrated on held-out contexts
for precision, selects (the best F0.5 among those precise enough); of overlapping ones the best stays.

``fit`` trains on the corpus at hand: around base spans in a bounded sample of windows (``WINDOWS``), the entity is
written anew in a form that no base pattern has, and candidates that fail a rule of their kind (checksum, range, a
sentence's end) are counter-examples; written shapes, true and false, are set into the same contexts. A window with all that is made from it is in one fold.

All scans are linear in the text. Contract: a null text counts as empty; an empty one has no spans; repeated
rows give equal spans; offsets are code points, ends exclusive; other columns stay as they are; an empty table is
fitted on the written contexts alone.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.llm import linear, shared

#: Kinds with base patterns, in the order that lists follow; then those that only candidates have.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret",)
EVERY = (*KINDS, *ADDED)
#: Windows of the corpus that train and calibrate the trees, at most, in order of a hash; and characters in one.
WINDOWS, WIDTH = 4_000, 240
#: Written examples set into each window.
WRITTEN = 3
TREES, DEPTH, RATE, BINS = 60, 4, 0.3, 32
#: Share of held-out selected spans that must be right.
PRECISION = 0.995
FOLDS = 3
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @: no run is scanned twice."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by kind as listed, then start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_AT = re.compile(r"[\[({]\x20?at\x20?[\])}]|(?<=\x20)at(?=\x20)|\x20@\x20", re.I)
_WORDS = re.compile(r"\x20?([A-Za-z0-9-]+)")
_DOT = re.compile(r"\x20?(?:[\[({]\x20?dot\x20?[\])}]|(?<=\x20)dot(?=\x20)|\.)\x20?([A-Za-z0-9-]+)", re.I)
#: Digit groups with what may stand between those of one number.
_NUMBER = re.compile(r"\(?(?:00)?[0-9]+(?:[\x20()._/-]{1,2}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?\[?\.\]?\x20?[0-9]{1,3}){3}(?![0-9.])")
#: Fixed names of what is kept secret.
_ASSIGNED = re.compile(r"\b(?:api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|token|secret|passw(?:or)?d|pwd|bearer)\b[\"']?(?:\x20?[:=]\x20?|\x20)[\"']?([^\s\"',;]+)", re.I)
_MIXED = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
#: Digits of a phone and of a card.
_PHONE_DIGITS, _CARD_DIGITS = range(7, 16), range(13, 20)
#: Digits that a phone's groups have on average at least, to be scored.
GROUP_SIZE = 1.5
#: Fixed cues before a span, by kind, and cues of something else.
_BEFORE = {
    "email": re.compile(r"mail|write|contact|reach", re.I),
    "ip": re.compile(r"\bip|host|server|addr|node", re.I),
    "card": re.compile(r"card|visa|credit|amex|pay", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|cell", re.I),
    "secret": re.compile(r"key|token|secret|passw|pwd|bearer|auth", re.I),
}
_ELSE = re.compile(r"version|\bv$|date|\bno\b|isbn|order|invoice|ref|page|score|total|eur|usd|commit|sha|md5|hash|uuid|digest|section|[$€£#]\s?$", re.I)


_BRACKETED = re.compile(r"[\[({]\x20?(?:at|dot)\x20?[\])}]", re.I)
_SPELLED_DOT = re.compile(r"\bdot\b", re.I)
#: The end of a sentence, which no address has.
_SENTENCE = re.compile(r"[.]\x20+[^\W\d_a-z]")


def _written_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with at and dot written out: a run that fails is not looked at again."""
    out, free = [], 0
    for m in _AT.finditer(text):
        if m.start() < free:
            continue
        word = _WORDS.match(text, m.end())
        if not word:
            continue
        end, dots = word.end(), 0
        while d := _DOT.match(text, end):
            end, dots = d.end(), dots + 1
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if dots and text[start : m.start()].strip():
            out.append((start, end))
        free = end
    return out


def _numbers(text: str) -> list[tuple[str, int, int]]:
    """All runs of neighbouring digit groups with the digits of a phone, or of a card with its checksum.

    From each group a run grows while it has no more digits than a card, so a text has at most as many runs as that for
    each group, whatever stands around it.
    """
    out, most = [], _CARD_DIGITS.stop - 1
    for m in _NUMBER.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            digits = ""
            for j in range(i, min(i + most, len(groups))):
                first, end = groups[j]
                if len(digits) + end - first > most:
                    break
                digits += text[first:end]
                if len(digits) in _PHONE_DIGITS:
                    opened = start - (text[start - 1 : start] == "(" and ")" in text[start:end])
                    out.append(("phone", opened, end))
                if len(digits) in _CARD_DIGITS and luhn(digits):
                    out.append(("card", start, end))
    return out


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Candidate spans; they may overlap each other and base spans."""
    out = [("email", *s) for s in _written_emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _QUAD.finditer(text)]
        out += _numbers(text)
        out += [("secret", *m.span()) for m in _MIXED.finditer(text) if _DIGIT.search(m[0])]
    out += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if len(m[1]) >= 6]
    return list(dict.fromkeys(out))


def candidates(text: str, base: list | None = None) -> list[tuple[str, int, int, list[float]]]:
    """Proposed spans that no base span overlaps and that aren't weak, with features."""
    free = Taken([(s, e) for _, s, e in (base_spans(text) if base is None else base)])
    return [(kind, s, e, describe(kind, text, s, e)) for kind, s, e in proposed(text) if free.clear(s, e) and not (kind == "phone" and weak(text[s:e]))]


def weak(body: str) -> bool:
    """Phones told digit by digit: under ``GROUP_SIZE`` digits a group. Lists of small numbers have very many such runs."""
    groups = _GROUP.findall(body)
    return sum(map(len, groups)) < GROUP_SIZE * len(groups)


class Taken:
    """Spans that don't overlap, in order: whether one more fits is found by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:  # base kinds may overlap each other
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def clear(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        return (i == 0 or self.ends[i - 1] <= start) and (i == len(self.starts) or end <= self.starts[i])

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def describe(kind: str, text: str, start: int, end: int) -> list[float]:
    """Features of a span's format and context."""
    body, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 2]
    d = _digits(body)
    groups = [len(g) for g in _GROUP.findall(body)]
    parts = [int(g[:6]) for g in _GROUP.findall(body)]
    cue, other = _last(_BEFORE[kind], before), _last(_ELSE, before)
    counts = Counter(body)
    entropy = -sum(n / len(body) * math.log2(n / len(body)) for n in counts.values())
    return [
        float(EVERY.index(kind)),
        float(len(d)),
        float(len(groups)),
        float(groups[-1] if groups else 0),
        float(groups[0] if groups else 0),
        float(max(groups, default=0) - min(groups, default=0)),
        float(bool(d) and luhn(d)),
        cue,
        other,
        float(cue > other),
        float(body.startswith(("(", "00", "0"))),
        float(body.count("/") + body.count(".")),
        float("[" in body or "(" in body),
        float(any(1900 <= p <= 2099 for p in parts)),
        float(max(parts, default=0) <= 255),
        float(before[-1:].isalnum() or before[-1:] in "-_=#$€£."),
        float(after[:1].isalnum() or after[:1] in "%-_"),
        float(bool(re.match(r"[\x20._/-]?[0-9]", after))),
        float(bool(re.search(r"[0-9][\x20._/-]?$", before))),
        float(d[:1] in ("3", "4", "5", "6")),
        float(len(body)),
        entropy,
        sum(c in "0123456789abcdefABCDEF" for c in body) / len(body),
        sum(c.isalpha() for c in body) / len(body),
        float(before[-1:] in "\"'" and before[-1:] != ""),
        float(bool(re.search(r"[:=]\s?[\"']?$", before))),
        float(len({c for c in body if not c.isalnum()})),
        float(len(_BRACKETED.findall(body))),
        float(len(_SPELLED_DOT.findall(body))),
        float(bool(_SENTENCE.search(body))),
        float(len(body) - 1 - max(body.rfind(c) for c in " .)]}")),
    ]


def _last(pattern: re.Pattern, text: str) -> float:
    """How near the pattern's last match is to the end: 0 if there is none."""
    at = -1
    for m in pattern.finditer(text):
        at = m.end()
    return 0.0 if at < 0 else 1 / (1 + len(text) - at)


@dataclass
class Trees:
    """Boosted regression trees on the logit; a tree is arrays of feature, cut, and leaf values, heap ordered."""

    prior: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            z += leaf[at - (len(feature))]
        return z


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting for log loss with Newton leaves; cuts are between at most ``BINS`` quantiles of a feature."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model, z, k = Trees(prior, []), np.full(len(y), prior), x.shape[1]
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)))[:-1] for c in x.T]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1) + np.arange(k) * BINS
    limit = np.concatenate([np.append(c, np.full(BINS - len(c), np.inf)) for c in cuts])  # by feature and bin: the cut above it
    n = 2**DEPTH - 1
    for _ in range(TREES):
        p = linear.sigmoid(z)
        g, h = y - p, p * (1 - p)
        feature, cut, leaf, at = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n + 1), np.zeros(len(y), np.int64)
        for node in range(n):
            inside = np.flatnonzero(at == node)
            if len(inside):
                flat = bins[inside].ravel()
                left = np.stack([np.bincount(flat, np.repeat(v[inside], k), k * BINS).reshape(k, BINS).cumsum(axis=1) for v in (g, h)])
                gs, hs = g[inside].sum(), h[inside].sum()
                gain = left[0] ** 2 / (left[1] + 1) + (gs - left[0]) ** 2 / (hs - left[1] + 1) - gs**2 / (hs + 1)
                gain[~np.isfinite(limit.reshape(k, BINS))] = 0
                best = int(gain.argmax())
                if gain.ravel()[best] > 1e-6:
                    feature[node], cut[node] = best // BINS, limit[best]
                at[inside] = 2 * node + 1 + (x[inside, feature[node]] > cut[node])
        for i in range(n + 1):
            inside = at == n + i
            leaf[i] = RATE * g[inside].sum() / (h[inside].sum() + 1)
        model.trees.append((feature, cut, leaf))
        z += leaf[at - n]
    return model


@dataclass
class Model:
    """Trees, the threshold on the logit by kind, and by kind what held-out candidates say: precision, recall, how many."""

    trees: Trees
    thresholds: dict[str, float]
    held_out: dict[str, dict[str, float]] = field(default_factory=dict)


class Writer:
    """Entities in shapes that base patterns don't have, and numbers and words that only look alike."""

    def __init__(self, rnd: random.Random):
        self.rnd = rnd

    def digits(self, n: int) -> str:
        return "".join(self.rnd.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return "".join(self.rnd.choice(("an", "er", "lo", "mi", "ta", "sen", "ru", "vel", "io")) for _ in range(self.rnd.randint(1, 3)))

    def mixed(self, n: int, letters: str) -> str:
        return "".join(self.rnd.choice(letters) for _ in range(n))

    def card(self, n: int = 16) -> str:
        d = self.rnd.choice("3456") + self.digits(n - 2)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def spaced(self, d: str, sizes: tuple[int, ...], sep: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(d[at : at + n])
            at += n
        return sep.join(x for x in [*out, d[at:]] if x)

    def email(self, local: str, parts: list[str]) -> str:
        a, b = self.rnd.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), (" @ ", " . "), ("[at]", ".")))
        return local + a + b.join(parts)

    def ip(self, parts: list[str]) -> str:
        return self.rnd.choice(("[.]", " . ", ". ")).join(parts)

    def card_text(self, d: str) -> str:
        sizes = (4, 6, 5) if len(d) == 15 else (4, 4, 4)
        return self.spaced(d, sizes, self.rnd.choice((".", "/", "_", "  ") if len(d) >= 16 else (" ", "-", ".")))

    def phone(self, d: str) -> str:
        r = self.rnd
        s = r.choice((" ", "-", "."))
        return r.choice((
            lambda: f"({d[:3]}) {d[3:6]}-{d[6:]}", lambda: self.spaced(d, (3, 3), s), lambda: d, lambda: f"0{d[:3]} {d[3:]}", lambda: f"(0{d[:2]}) {d[2:]}",
            lambda: f"0049 {d[:3]} {d[3:]}", lambda: f"00{d[:2]} {self.spaced(d[2:], (3, 3), ' ')}", lambda: self.spaced("0" + d, (4, 2, 2), r.choice((" ", "/"))),
        ))()

    def secret(self) -> str:
        n, r = self.rnd.choice((20, 24, 32, 40, 64)), self.rnd
        return self.mixed(n, r.choice(("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-")))

    def true(self) -> tuple[str, str, str]:
        """(kind, what leads up to the span, the span)"""
        r = self.rnd
        kind = r.choice(EVERY)
        if kind == "secret":
            name = r.choice(("token", "api_key", "API-KEY", "secret", "password", "access_key", "client_secret", "Bearer"))
            q = r.choice(('"', "'", ""))
            value = self.secret() if r.random() < 0.8 else self.word() + self.digits(3) + r.choice("!?#%")
            return kind, name + (" " if name == "Bearer" else r.choice((" = ", "=", ": ")) + q), value
        span = {
            "email": lambda: self.email(f"{self.word()}{r.choice(('.', '_', ''))}{self.word()}", [self.word() for _ in range(r.randint(1, 5))] + [r.choice(("com", "org", "net"))]),
            "ip": lambda: self.ip([str(r.randint(1, 254)) for _ in range(4)]),
            "card": lambda: self.card_text(self.card(r.choice((15, 16, 16)))),
            "phone": lambda: self.phone(r.choice("23456789") + self.digits(r.choice((8, 9, 9)))),
        }[kind]()
        cue = {"email": ("mail", "write to", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "credit card"), "phone": ("call", "tel", "phone", "mobile")}[kind]
        return kind, r.choice(cue) + r.choice((" ", ": ")), span

    def false(self) -> str:
        r, num = self.rnd, self.digits
        four = lambda d, s: self.spaced(d, (4, 4, 4), s)
        year, month, day = r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28)
        hexed = lambda n: self.mixed(n, "0123456789abcdef")
        return r.choice((
            lambda: f"{year}-{month:02}-{day:02}-{num(2)}", lambda: f"{year}-{month:02}-{day:02} {num(2)}", lambda: f"{day:02}.{month:02}.{year}", lambda: f"{year}/{month}/{day}",
            lambda: f"version {r.randint(1, 20)}. {r.randint(0, 9)}. {r.randint(0, 9)}. {r.randint(0, 99)}", lambda: f"order {num(r.randint(7, 17))}", lambda: num(r.randint(7, 19)),
            lambda: f"ref {four(num(16), r.choice(('.', '/', ' ')))}", lambda: f"isbn {num(3)}-{num(2)}-{num(4)}-{num(3)}", lambda: f"{num(2)} {num(3)} {num(3)}",
            lambda: f"total ${num(2)} {num(3)} {num(3)}", lambda: f"{self.word()} at {self.word()} dot {self.word()}", lambda: f"{num(2)}/{num(2)}/{num(3)}",
            lambda: f"{num(3)} {num(3)} {num(4)}", lambda: f"section {r.randint(1, 9)}. {r.randint(1, 9)}. {r.randint(1, 9)}. {r.randint(1, 9)} ", lambda: f"invoice {num(10)}",
            lambda: f"commit {hexed(40)}", lambda: f"sha1 {hexed(40)}", lambda: f"md5: {hexed(32)}", lambda: f"uuid {hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}",
            lambda: f"hash={hexed(64)}", lambda: f"{self.word()}-{self.word()}-{self.word()}-{self.word()}-{num(2)}-{self.word()}-{self.word()}", lambda: f"token {self.word()} {self.word()}",
            lambda: f"the secret {self.word()}{self.word()}", lambda: f"https://{self.word()}.org/{self.word()}/{self.word()}/{num(6)}/{self.word()}{self.word()}{self.word()}",
            lambda: f"{self.word()} at {self.word()}. {self.word().capitalize()}", lambda: f"{self.word()} at {self.word()}. {self.word()}. {self.word()}", lambda: " ".join(num(2) for _ in range(8)), lambda: f"{num(3)}.{num(4)}, {num(2)}.{num(5)}", lambda: f"page {num(3)} of {num(4)}",
        ))()


def _again(kind: str, body: str, write: Writer) -> str | None:
    """A base span's entity in a form that base patterns don't have."""
    if kind == "email":
        local, domain = body.split("@", 1)
        return write.email(local, domain.split("."))
    if kind == "ip":
        return write.ip(body.split("."))
    if kind == "card":
        d = _digits(body)
        return write.card_text(d) if len(d) == 16 else None
    d = _digits(body)[-10:]
    return write.phone(d) if len(d) >= 9 else None


def _examples(window: str, write: Writer) -> list[tuple[list[float], bool, str]]:
    """Candidates in what is made from a window: features, whether right, kind."""
    out, base = [], base_spans(window)

    def collect(text: str, kind: str | None, start: int, end: int):
        for k, s, e, f in candidates(text):
            if s < end and e > start:  # what was written; other candidates have no label
                out.append((f, k == kind and abs(s - start) <= 1 and abs(e - end) <= 1, k))

    for kind, s, e in base:
        if (span := _again(kind, window[s:e], write)) is not None:
            collect(window[:s] + span + window[e:], kind, s, s + len(span))
    for k, s, e, f in candidates(window, base):
        d = _digits(window[s:e])
        over = k == "ip" and any(int(g) > 255 for g in _GROUP.findall(window[s:e]))
        if over or k == "card" and len(d) >= 15 and not luhn(d) or k == "email" and _SENTENCE.search(window[s:e]):
            out.append((f, False, k))  # fails the rule of its kind
    gaps = [m.start() for m in re.finditer(r"(?<=[^\W\d])\x20(?=[^\W\d])", window)] or [0]
    for _ in range(WRITTEN):
        at = write.rnd.choice(gaps)
        left, right = window[:at] + " ", " " + window[at:].lstrip()
        if write.rnd.random() < 0.5:
            kind, lead, span = write.true()
            lead = lead if kind in ("secret", "phone", "ip") or write.rnd.random() < 0.85 else ""
            close = {'"': '"', "'": "'"}.get(lead[-1:], "")
            collect(left + lead + span + close + right, kind, len(left + lead), len(left + lead + span))
        else:
            span = write.false()
            collect(left + span + right, None, len(left), len(left + span))
    return out


def train(windows: list[str], seed: int = 7) -> Model:
    """Trees on two thirds of the windows, thresholds from the rest."""
    write = Writer(random.Random(seed))
    made = [(e, i % FOLDS) for i, w in enumerate(windows) for e in _examples(w, write)]
    x = np.array([f for (f, _, _), _ in made])
    y = np.array([right for (_, right, _), _ in made], float)
    kinds, held = np.array([k for (_, _, k), _ in made]), np.array([fold for _, fold in made]) == 0
    trees = boost(x[~held], y[~held])
    z, model = trees.logit(x), Model(trees, {})
    for k in EVERY:
        own = held & (kinds == k)
        order = np.argsort(-z[own], kind="stable")
        score, right = z[own][order], y[own][order]
        hits, taken = np.cumsum(right), np.arange(1, len(right) + 1)
        worth = np.where(hits / taken >= PRECISION, 1.25 * hits / (taken + 0.25 * right.sum()), 0.0)  # F0.5 where it is precise
        worth[:-1][score[:-1] == score[1:]] = 0  # a threshold can't part equal scores
        n = int(worth.argmax()) + 1 if len(worth) and worth.max() > 0 else 0
        model.thresholds[k] = float((score[n - 1] + (score[n] if n < len(score) else score[n - 1] - 1)) / 2) if n else float("inf")
        model.held_out[k] = {"precision": float(right[:n].mean()) if n else 1.0, "recall": float(right[:n].sum() / max(1, right.sum())), "spans": int(right.sum()), "candidates": len(right)}
    return model


@functools.cache
def written_model() -> Model:
    """Without a corpus: contexts are written too."""
    write = Writer(random.Random(3))
    return train([" ".join(write.word() for _ in range(24)) for _ in range(1_500)])


def fit(docs: DataFrame, text: str = "text", windows: int = WINDOWS) -> Model:
    """A model for a corpus, from at most ``windows`` windows of as many texts.

    Half of them are around the first @ or + or the first three digits of texts that have some, half are anywhere.
    """
    t, h = F.col(text), F.xxhash64(F.col(text), F.lit(1))
    sign = F.least(*(F.when(p > 0, p) for p in (F.instr(t, "@"), F.instr(t, "+"), F.regexp_instr(t, F.lit("[0-9]{3}")))), F.lit(1 << 30))
    some = docs.where(F.length(text) > 0).select(t.alias("t"), h.alias("h"), F.length(text).alias("n"), sign.alias("sign"))
    cut = lambda at: F.substring("t", F.greatest(F.lit(1), at).cast("int"), F.lit(WIDTH)).alias("w")
    around = some.where(F.col("sign") < 1 << 30).select("h", cut(F.col("sign") - WIDTH // 2)).distinct().orderBy("h", "w").limit(windows // 2)
    anywhere = some.select("h", cut(F.pmod("h", F.col("n")) + 1 - WIDTH // 2)).distinct().orderBy("h", "w").limit(windows // 2)
    found = [r["w"] for r in around.union(anywhere).collect()]  # ``windows`` windows at most
    write = Writer(random.Random(3))
    return train(found + [" ".join(write.word() for _ in range(24)) for _ in range(max(0, 600 - len(found)))])


def find(text: str, model: Model | None = None) -> tuple[list, list]:
    """(base spans, all spans): kind, start, end, by kind as listed, then start."""
    base = base_spans(text)
    found = candidates(text, base)
    if not found:
        return base, base
    model = model or written_model()
    z = model.trees.logit(np.array([f for *_, f in found]))
    taken, added = Taken([(s, e) for _, s, e in base]), []
    for i in np.argsort(-z, kind="stable").tolist():
        kind, start, end, _ = found[i]
        if z[i] >= model.thresholds[kind] and taken.clear(start, end):
            added.append((kind, start, end))
            taken.add(start, end)
    return base, sorted(base + added, key=lambda s: (EVERY.index(s[0]), s[1]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with ``pii``: struct of ``base`` and ``spans`` (arrays of kind, start, end) and the ``redacted`` text.

    Without a ``model``, one is fitted on ``docs``.
    """
    shared.session(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text))  # some KB, whatever the table
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.arrow_udf(f"struct<base:{span},spans:{span},redacted:string>")
    def pii(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        shared.working("pii")
        rows = [(t or "", *find(t or "", sent.value)) for t in texts.to_pylist()]
        as_list = lambda k: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r[k]] for r in rows], kind)
        return pa.StructArray.from_arrays([as_list(1), as_list(2), pa.array([redacted(r[0], r[2]) for r in rows], pa.string())], ["base", "spans", "redacted"])

    return docs.withColumn(shared.fresh(docs, "pii"), pii(F.col(text)))


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with personal data replaced in the text; a null text stays null."""
    name = shared.fresh(docs, "pii")
    found = detect(docs, text, model)
    return found.withColumn(text, F.when(F.col(text).isNotNull(), F.col(f"{name}.redacted"))).drop(name)
