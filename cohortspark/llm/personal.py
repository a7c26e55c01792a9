"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

The field reads stretches of text that could hold an address or a number. A stretch is cut into tokens; a segmentation
is a row of single tokens outside and of segments of at most LONGEST tokens with a kind, and its score is the sum over
its segments of the weights of features of the whole span (groups of digits, separators, check digits, what stands
beside it), and of a weight for segments that touch. Training maximises the likelihood of known segmentations by sums over all
segmentations (forward and backward); decoding takes the best one, so boundaries and kinds are chosen together. Known
segmentations are the fixed patterns' spans in a bounded sample of the documents, and written examples: the same data
in other notations (addresses spelled with "at" and "dot", numbers without a plus), and numbers that are none (dates, versions, ids).
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_batches
from cohortspark.llm._sample import drawn

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment, and documents that are drawn for training.
LONGEST, SAMPLE_ROWS = 24, 2000
#: Written examples, passes over all examples, and the step and shrinkage of training.
EXAMPLES, PASSES, STEP, SHRINK = 1500, 6, 0.5, 1e-4

# the fixed patterns; no part is tried again, so time is linear (each gives the spans of the plain pattern)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# the field's stretches, tokens and notations
_NUMBERS = re.compile(r"[0-9+(][0-9().+\x20/-]*+")
_AT = re.compile(r"@|\x20?[\[(]at[\])]\x20?", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_ADDRESS = re.compile(r"([A-Za-z0-9._%+-]+)(@|\x20?[\[(]at[\])]\x20?)([A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)*)", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")
#: Characters of a local part in the field's stretches.
_LOCAL = 64
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Words that tell what a number is.
_CUES = frozenset("tel phone call fax mobile cell whatsapp card visa mastercard credit ip host server addr address mail email contact version ver release isbn order invoice ref no id date since born total article".split())


def luhn(digits: str) -> bool:
    """The check digit of a card number."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(c)] if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def _octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, leftmost and non-overlapping within each; matches that fail a test are left out."""
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1]]
    if _DIGITS.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if m[1] and all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


class Stretch(NamedTuple):
    """A stretch of a text and the bounds of its tokens."""

    text: str
    tokens: list[tuple[int, int]]
    numbers: bool


def stretches(text: str) -> Iterator[Stretch]:
    """The parts of a text that could hold a span, those of one sort in order and apart."""
    if _DIGITS.search(text):
        for m in _NUMBERS.finditer(text):
            if m.end() - m.start() >= 7 and sum(map(len, _DIGITS.findall(m[0]))) >= 7:
                yield Stretch(text, [t.span() for t in _TOKEN.finditer(text, m.start(), m.end())], True)
    done = 0
    if "@" in text or "(" in text or "[" in text:
        for m in _AT.finditer(text):
            host = _HOST.match(text, m.end())
            a = m.start()
            while a > max(done, m.start() - _LOCAL) and text[a - 1] in _LOCAL_CHARS:
                a -= 1
            if host and a < m.start():
                yield Stretch(text, [t.span() for t in _TOKEN.finditer(text, a, host.end())], False)
                done = host.end()


def _side(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-./_@:#$%,;=" else "other"


def _cue(text: str, a: int) -> str:
    words = re.findall("[a-z]+", text[max(0, a - 16) : a].lower())
    return words[-1] if words and words[-1] in _CUES else ""


@lru_cache(maxsize=50_000)
def _inner(span: str, numbers: bool) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The kinds that a span could be, each with the features of the span alone."""
    if not numbers:
        m = _ADDRESS.fullmatch(span)
        if not m:
            return ()
        labels = re.split(r"\.|\x20?[\[(]dot[\])]\x20?", m[3], flags=re.IGNORECASE)
        return (("email", (f"at={'@' if m[2] == '@' else 'spelled'}", f"labels={min(len(labels), 4)}", f"top={'word' if labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24 else 'other'}", f"edge={m[1][0].isalnum()}{m[1][-1].isalnum()}", f"local={min(len(m[1]), 3)}", f"both={m[2] == '@'}{len(labels) > 1}")),)
    groups = _DIGITS.findall(span)
    between = _DIGITS.split(span)
    total = sum(map(len, groups))
    marks = between[1:-1]
    if not 4 <= total <= 19 or any(len(x) > 2 for x in marks) or between[-1]:
        return ()
    head, kinds = between[0], []
    pattern = "-".join(str(len(g)) for g in groups[:6])
    sort = "".join(sorted({x or "_" for x in marks}))
    date = len(groups) == 3 and sorted(len(g) for g in groups) in ([2, 2, 4], [1, 2, 4], [1, 1, 4])
    if len(groups) == 4 and set(marks) == {"."} and not head:
        kinds.append(("ip", (f"octets={all(map(_octet, groups))}", f"zero={any(g[0] == '0' and len(g) > 1 for g in groups)}")))
    if 13 <= total <= 19 and len(set(marks)) <= 1 and not head and sort in ("", " ", "-", ".", "/"):
        kinds.append(("card", (f"luhn={luhn(''.join(groups))}", f"n={total}", f"pattern={pattern}", f"marks={sort}", f"luhn={luhn(''.join(groups))}&pattern={pattern if len(groups) > 1 else total}")))
    if 7 <= total <= 15 and head in ("", "+", "(", "+(") and len(groups) <= 8:
        kinds.append(("phone", (f"head={head}", f"n={total}", f"pattern={pattern}", f"marks={sort}", f"head={head}&n={total}", f"head={head}&pattern={pattern}&marks={sort}", f"date={date}", f"one={len(groups) == 1}", f"octets={len(groups) == 4 and set(marks) == {'.'}}", f"luhn={total >= 13 and luhn(''.join(groups))}")))
    return tuple(kinds)


def _candidates(s: Stretch, stop: int) -> Iterator[tuple[int, str, tuple[str, ...]]]:
    """Segments that end before token ``stop``: first token, kind and features."""
    text, b = s.text, s.tokens[stop - 1][1]
    if not text[b - 1].isalnum():
        return
    right = _side(text[b : b + 1])
    for i in range(stop - 1, max(-1, stop - 1 - LONGEST), -1):
        a = s.tokens[i][0]
        if text[a].isalnum() or text[a] in "+(":
            for kind, inner in _inner(text[a:b], s.numbers):
                yield i, kind, (f"{kind}", f"{kind}|left={_side(text[a - 1 : a] if a else '')}", f"{kind}|right={right}", f"{kind}|next={right}{_side(text[b + 1 : b + 2])}", f"{kind}|cue={_cue(text, a)}", *(f"{kind}|{x}" for x in inner))


def decode(s: Stretch, weight: dict[str, float]) -> list[tuple[str, int, int]]:
    """The segments of the best segmentation; of equal ones the one with later and shorter segments."""
    touch = weight.get("touch", 0.0)
    best = [(0.0, -math.inf)]
    back: list[tuple] = [None]
    for k in range(1, len(s.tokens) + 1):
        top, how = -math.inf, None
        for i, kind, names in _candidates(s, k):
            own = sum(weight.get(n, 0.0) for n in names)
            free, tied = best[i]
            value = max(free, tied + touch) + own
            if value > top:
                top, how = value, (i, kind, tied + touch > free)
        free, tied = best[-1]
        best.append((max(free, tied), top))
        back.append((tied > free, how))
    out, k = [], len(s.tokens)
    inside = k and best[k][1] > best[k][0]
    while k:
        if inside:
            i, kind, inside = back[k][1]
            out.append((kind, s.tokens[i][0], s.tokens[k - 1][1]))
            k = i
        else:
            inside = back[k][0]
            k -= 1
    return out[::-1]


def _plus(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Known(NamedTuple):
    """A stretch as training reads it: segments by (first token, stop, features), and which of them are right."""

    n: int
    segments: list[tuple[int, int, list[int]]]
    right: frozenset[int]


def step(x: Known, weight: list[float], touch: int) -> tuple[float, dict[int, float]]:
    """Log likelihood of the known segmentation and its gradient, by sums over all segmentations."""
    own = [sum(weight[f] for f in names) for _, _, names in x.segments]
    by_end: list[list[int]] = [[] for _ in range(x.n + 1)]
    by_start: list[list[int]] = [[] for _ in range(x.n + 1)]
    for e, (i, k, _) in enumerate(x.segments):
        by_end[k].append(e)
        by_start[i].append(e)
    w = weight[touch]
    # sums of what stands before a place, after a free token (or nothing) and after a segment
    free, tied = [0.0], [-math.inf]
    for k in range(1, x.n + 1):
        t = -math.inf
        for e in by_end[k]:
            i = x.segments[e][0]
            t = _plus(t, _plus(free[i], tied[i] + w) + own[e])
        free.append(_plus(free[k - 1], tied[k - 1]))
        tied.append(t)
    # and of what stands behind it
    after_free, after_tied = [0.0] * (x.n + 1), [0.0] * (x.n + 1)
    for k in range(x.n - 1, -1, -1):
        f, t = after_free[k + 1], after_free[k + 1]
        for e in by_start[k]:
            rest = own[e] + after_tied[x.segments[e][1]]
            f, t = _plus(f, rest), _plus(t, rest + w)
        after_free[k], after_tied[k] = f, t
    total = _plus(free[x.n], tied[x.n])
    grad: dict[int, float] = {}
    value, stops = -total, {x.segments[e][1] for e in x.right}
    for e, (i, k, names) in enumerate(x.segments):
        p = math.exp(_plus(free[i], tied[i] + w) + own[e] + after_tied[k] - total)
        pw = math.exp(tied[i] + w + own[e] + after_tied[k] - total) if tied[i] > -math.inf else 0.0
        d = (e in x.right) - p
        for f in names:
            grad[f] = grad.get(f, 0.0) + d
        met = e in x.right and i in stops
        grad[touch] = grad.get(touch, 0.0) + met - pw
        value += own[e] * (e in x.right) + w * met
    return value, grad


_PARTS = "ka lo mi ren tas vo ul be sor dan fi gre hu pol".split()


def _examples(seed: int, n: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Written texts with their spans: notations that the fixed patterns know and others, and numbers that are no personal data."""
    g = random.Random(seed)
    num = lambda k: "".join(g.choice("0123456789") for _ in range(k))
    word = lambda: "".join(g.choice(_PARTS) for _ in range(g.randint(1, 3)))

    def card() -> str:
        k = g.choice((15, 16, 16, 16))
        d = g.choice("3456") + num(k - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        s = g.choice(("", " ", "-", ".", "/"))
        return s.join((d[:4], d[4:10], d[10:])) if k == 15 else s.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(g.randint(201, 989)), num(3), num(4)
        return g.choice((f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+{g.randint(20, 98)} {num(3)} {num(7)}", f"+{g.randint(20, 98)}{num(9)}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"0{g.randint(11, 99)} {num(4)} {num(4)}", f"(0{g.randint(11, 99)}) {num(4)} {num(4)}"))

    def mail() -> str:
        at, dot = g.choice((("@", "."), ("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")))
        return g.choice((word(), f"{word()}.{word()}", f"{word()}_{num(2)}", f"{word()}.{num(2)}")) + at + dot.join(g.choice(((word(), "com"), (f"mail{num(1)}", "example", "com"), (word(), word(), "org"), (f"{word()}-{word()}", "net"))))

    address = lambda: ".".join(str(g.randint(0, 255)) for _ in range(4))
    none = (
        lambda: f"{g.randint(1900, 2099)}-{g.randint(1, 12):02d}-{g.randint(1, 28):02d}", lambda: f"{g.randint(1, 28)}.{g.randint(1, 12)}.{g.randint(1900, 2099)}", lambda: f"{g.randint(1, 12)}/{g.randint(1, 28)}/{g.randint(1900, 2099)}",
        lambda: f"{g.randint(1900, 2020)}-{g.randint(1900, 2020)}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: num(g.randint(7, 19)), lambda: f"{num(2)}.{num(8)}", lambda: f"{num(4)} {num(4)} {num(4)}", lambda: f"{g.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}",
        lambda: f"{g.randint(0, 9)}.{num(3)}.{num(3)}", lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(2)}-{num(5)}-{num(2)}", lambda: " ".join(num(g.randint(1, 3)) for _ in range(g.randint(4, 12))), lambda: f"({num(4)}) {num(3)}", lambda: f"{word()} (at) {word()} (on) {word()}", lambda: f"{word()} [{word()}] {num(3)}",
    )
    made = {"card": card, "phone": phone, "email": mail, "ip": address}
    cues = {"card": ("card", "visa", "credit"), "phone": ("call", "tel", "phone"), "email": ("mail", "contact"), "ip": ("host", "ip"), None: ("order", "invoice", "date", "version", "isbn", "ref")}
    for _ in range(n):
        text, spans = f"{word()} {word()} ", []
        for _ in range(g.choice((1, 1, 1, 2))):
            kind = g.choice((*KINDS, None, None))
            if g.random() < 0.3:
                text += g.choice(cues[kind]) + g.choice((" ", ": ", " "))
            part = made[kind]() if kind else g.choice(none)()
            if not kind and g.random() < 0.3:
                part = word() + part + g.choice(("", word()))
            if kind:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part + g.choice((" ", " ", ", ", ".\n", "!!! ", "### ", " - "))
            text += f"{word()} "
        yield text, spans


def train(docs: DataFrame | None, rows: int = SAMPLE_ROWS, examples: int = EXAMPLES, passes: int = PASSES) -> dict[str, float]:
    """Weights by feature, fitted on the fixed patterns' spans in about ``rows`` documents at most and on written examples.

    The sample is drawn by a hash over all texts with a digit or an at sign, so it is the same in every run; without such
    texts the written examples do.
    """
    known = list(_examples(11, examples))
    if docs is not None:
        texts = drawn(docs.where(F.col("text").rlike("[0-9@]")).select("text"), rows).select(F.expr("sequence(1, least(20, 1 + length(text) div 4000))").alias("k"), "text")
        # of a long text up to twenty pieces, so that the sample is bounded in bytes too
        texts = texts.select(F.explode("k").alias("k"), "text").selectExpr("substring(text, (k - 1) * greatest(4000, length(text) div 20) + 1, 4000) AS text")
        for t in sorted({r.text for r in texts.collect()}):
            known.append((t, base_spans(t)))
    number: dict[str, int] = {}
    cases = []
    for text, spans in known:
        for s in stretches(text):
            segments, right = [], set()
            a, b = s.tokens[0][0], s.tokens[-1][1]
            want = {x for x in spans if a <= x[1] and x[2] <= b and (x[0] == "email") != s.numbers}
            for k in range(1, len(s.tokens) + 1):
                for i, kind, names in _candidates(s, k):
                    if (kind, s.tokens[i][0], s.tokens[k - 1][1]) in want:
                        right.add(len(segments))
                    segments.append((i, k, [number.setdefault(n, len(number)) for n in names]))
            if segments and len(right) == len(want) and len(s.tokens) <= 200:
                cases.append(Known(len(s.tokens), segments, frozenset(right)))
    touch = len(number)
    weight, square = [0.0] * (touch + 1), [1e-3] * (touch + 1)
    g = random.Random(5)
    for _ in range(passes):
        g.shuffle(cases)
        for case in cases:
            for f, d in step(case, weight, touch)[1].items():
                d -= SHRINK * weight[f]
                square[f] += d * d
                weight[f] += STEP * d / math.sqrt(square[f])
    return {n: weight[k] for n, k in number.items()} | {"touch": weight[touch]}


def found_spans(text: str, weight: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the fixed patterns, and the field's spans that touch none of them."""
    base = base_spans(text)
    own = sorted({x for s in stretches(text) for x in decode(s, weight)}, key=lambda x: x[1:])
    taken = sorted((a, b) for _, a, b in base)
    added, k, far = [], 0, 0
    for x in own:
        while k < len(taken) and taken[k][0] < x[2]:
            far = max(far, taken[k][1])
            k += 1
        if far <= x[1]:
            added.append(x)
            far = max(far, x[2])
    return base, added


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def scan(docs: DataFrame, weight: dict[str, float]) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (of the fixed patterns), n_added, base_spans and spans.

    Spans as text: kind:start:end by kind, then start, comma-joined; positions are code points, end exclusive. Null text counts as
    empty; repeated rows and null ids stay; an empty table gives an empty result; other columns are not read. Whole
    texts of any length are read in linear time. Row-local, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    names = [f"n_{k}" for k in KINDS]

    def make():
        weight = shared.value

        def work(cols):
            rows = [found_spans(t or "", weight) for t in cols["text"]]
            out = {"doc_id": cols["doc_id"], "n_added": [len(a) for _, a in rows], "base_spans": [spelled(b) for b, _ in rows], "spans": [spelled(b + a) for b, a in rows]}
            return out | {f"n_{k}": [sum(x[0] == k for x in b) for b, _ in rows] for k in KINDS}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", n_added long, base_spans string, spans string")
