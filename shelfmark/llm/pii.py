"""Operator 9, PII: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns find e-mail addresses, IP addresses, card and telephone numbers in their plain forms; these spans always stay.
Around digits, at-signs and spelled-out at-signs and dots the text is cut into tokens. There the random field scores whole
candidate spans (digit groups and their separators, check digit, cue word before, what stands next to the span) and the step
from one segment's type to the next's; a dynamic program over bounded spans (MOST_TOKENS, but for spelled-out addresses) and
the type before chooses boundaries and types together; a token outside is a segment too. A spelled-out e-mail address is
looked for up to AROUND characters on either side of its at-sign. Spans that overlap one of the patterns' are not added. Weights are trained by gradient descent on sentences made here by a seeded
generator, so no personal data is learned; every text is scored whole.

Null and empty texts have no spans. Repeated rows and equal or null ids stay rows of their own; an empty table gives no
rows; further columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 24
AROUND = 320  # the longest address there is has 254 characters
OUTSIDE = "outside"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits that fails from its start fails from within
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """The patterns' own spans, leftmost and not overlapping within a kind."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    at, before = text.find("@"), 0
    while at >= 0:
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            before = host.end()
            found["email"].append((start, before))
        at = text.find("@", max(at + 1, before))
    first = _DIGIT.search(text)
    if first:
        for m in _IP.finditer(text, first.start()):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text, first.start()):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        plus = text.find("+")
        if plus >= 0:
            for m in _PHONE.finditer(text, plus):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
    return found


# --- candidate spans -----------------------------------------------------------------------------------------------

_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().+-]*[0-9]")  # what may hold an IP address, a card or a telephone number
_SIGN = r"(?:@|\s*[\[({<]\s*(?:at|AT)\s*[\])}>]\s*|\s+(?:at|AT)\s+)"
_POINT = r"(?:\.|\s*[\[({<]\s*(?:dot|DOT)\s*[\])}>]\s*|\s+(?:dot|DOT)\s+)"
_SPELLED = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_POINT}[A-Za-z0-9_%+-]+){{0,3}}{_SIGN}[A-Za-z0-9-]+(?:{_POINT}[A-Za-z0-9-]+){{1,4}}")
_GAP = r"\s*[\[({<]?\s*(?:\.|dot|DOT)\s*[\])}>]?\s*"
_QUAD = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_GAP}[0-9]{{1,3}}){{3}}(?![0-9])")  # an IP address, its dots set apart or spelled out
_HINT = re.compile(r"@|(?:[\[({<]\s*|\s)(?:at|AT)(?:\s*[\])}>]|\s)")
_DOTS = re.compile(r"\.|dot|DOT")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\s:.#(]*$")
#: Words that announce each kind.
CUES = {
    "email": frozenset("mail email contact write reach".split()),
    "ip": frozenset("ip host server address from".split()),
    "card": frozenset("card visa mastercard credit payment".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell dial".split()),
}


class Taken:
    """The union of spans, for questions about overlap."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def covers(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.ends[k] >= b


def zones(text: str, taken: Taken) -> list[Span]:
    """Parts of the text that a pattern doesn't cover already and that may hold a span."""
    out = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() >= 7 and not taken.covers(*m.span()):
                out.append(m.span())
        for m in _QUAD.finditer(text):
            if not taken.meets(*m.span()):
                out.append(m.span())
    if ("at" in text or "AT" in text or "@" in text) and _DOTS.search(text):
        last = 0
        for hint in _HINT.finditer(text):
            if hint.start() < last:
                continue
            first = max(last, hint.start() - AROUND)
            for m in _SPELLED.finditer(text, first, min(len(text), hint.end() + AROUND)):
                if m.end() > hint.start() and not taken.meets(*m.span()):
                    out.append(m.span())
                last = max(last, m.end())
                break
    return _joined(out)


def _joined(spans: list[Span]) -> list[Span]:
    """Spans that overlap as one."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Zone:
    """A zone's tokens, and the features of each candidate span by (first token, past last token, kind)."""

    def __init__(self, text: str, start: int, end: int, taken: Taken) -> None:
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.spans: dict[tuple[int, int], dict[str, list[str]]] = {}
        cue = _WORD_BEFORE.search(text, max(0, start - 24), start)
        word = cue[1].lower() if cue else ""
        held = list(accumulate((taken.meets(*t) for t in self.tokens), initial=0))
        if _SPELLED.fullmatch(text, start, end):
            if not held[-1]:
                self.spans[0, len(self.tokens)] = {"email": email_features(text, start, end, word)}
            return
        for i, (a, _) in enumerate(self.tokens):
            if text[a].isspace() or text[a] in ").-]" or text[a].isalpha():
                continue
            for j in range(i + 1, min(len(self.tokens), i + MOST_TOKENS) + 1):
                b = self.tokens[j - 1][1]
                if not text[b - 1].isdigit() or held[j] > held[i]:
                    continue
                own, before = text[a:b], word if i == 0 else ""
                quad = text[a].isdigit() and _QUAD.fullmatch(own)
                number = _NUMBER.fullmatch(own) and sum(c.isdigit() for c in own) >= 7
                if quad or number:
                    features = number_features(text, a, b)
                    kinds = (("ip",) if quad else ()) + (("card", "phone") if number else ())
                    self.spans[i, j] = {k: [f"{k}|{f}" for f in [*features, f"cue {before in CUES[k]}"]] for k in kinds}


def _edges(text: str, a: int, b: int) -> list[str]:
    left, right = text[a - 1 : a], text[b : b + 1]
    more = text[b : b + 2]
    return [f"left {left.isalnum() or left in '_/$€#=&' and left != ''}", f"right {right.isalnum() or right in '_/%$€=' and right != ''}", f"goes on {len(more) == 2 and more[0] in '.-,:/' and more[1].isalnum()}", f"after {left in '.-,:/' and left != ''}"]


def number_features(text: str, a: int, b: int) -> list[str]:
    """Of the whole span, whatever its kind."""
    own = text[a:b]
    groups = re.findall("[0-9]+", own)
    digits = "".join(groups)
    gaps = sorted(set(re.sub("[0-9]", "", own)) - set("dotDOT"))
    pattern = "-".join(str(min(len(g), 9)) for g in groups)
    apart = sorted(set(re.findall("[^0-9]+", own))) if _QUAD.fullmatch(own) else ""
    return [
        "any", f"apart {apart}", f"digits {min(len(digits), 20)}", f"groups {pattern if len(groups) < 6 else 'many'}", f"gaps {''.join(gaps)}", f"luhn {len(digits) in range(16, 20) and luhn(digits)}",
        f"starts {own[0] if own[0] in '+(' else ''}", f"quad {bool(_QUAD.fullmatch(own))} {all(len(g) <= 3 and int(g) <= 255 for g in groups)}",
        f"brackets {own.count('(') == own.count(')')}", f"double {bool(re.search('[ .-]{3}', own))}", f"year {bool(re.match('(19|20)[0-9][0-9][-. ]', own))}", *_edges(text, a, b),
    ]


def email_features(text: str, a: int, b: int, word: str) -> list[str]:
    own = text[a:b]
    sign = re.search(_SIGN, own)
    how = "@" if sign[0] == "@" else "brackets" if re.search(r"[\[({<]", sign[0]) else "word"
    points = re.findall(_POINT, own[sign.end() :])
    spelled = sum(p != "." for p in points)
    last = re.split(_POINT, own)[-1]
    known = last.lower() in ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu")
    return [f"email|{f}" for f in ("any", f"sign {how}", f"points {'all' if spelled == len(points) else 'some' if spelled else 'plain'} {how}", f"known {known} {how}", f"last {min(len(last), 7)}", f"cue {word in CUES['email']}", f"lines {chr(10) in own}")]


# --- the random field ----------------------------------------------------------------------------------------------


def _step(before: str, after: str) -> str:
    """The feature of one segment's type after another's."""
    return f"{before}>{after}"


def _segments(zone: Zone, weights: dict[str, float]) -> tuple[list[list[tuple]], list[str]]:
    """(the segments that end at each token: (start, type, features, score), the types there are)."""
    ends: list[list[tuple]] = [[] for _ in range(len(zone.tokens) + 1)]
    for j in range(1, len(ends)):
        ends[j].append((j - 1, OUTSIDE, (), 0.0))
    kinds = {OUTSIDE}
    for (i, j), own in zone.spans.items():
        for kind, features in own.items():
            kinds.add(kind)
            ends[j].append((i, kind, features, sum(weights.get(f, 0.0) for f in features)))
    return ends, sorted(kinds)


def decode(zone: Zone, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The best segmentation of the zone into typed spans and outside tokens."""
    if not zone.spans:
        return []
    ends, _ = _segments(zone, weights)
    best: list[dict[str, tuple]] = [{OUTSIDE: (0.0, None)}, *({} for _ in zone.tokens)]
    for j in range(1, len(best)):
        for i, kind, _, score in ends[j]:
            for before, (value, _) in best[i].items():
                new = value + score + weights.get(_step(before, kind), 0.0)
                if kind not in best[j] or new > best[j][kind][0]:
                    best[j][kind] = (new, (i, before))
    out, j = [], len(zone.tokens)
    kind = max(best[j], key=lambda k: (best[j][k][0], k == OUTSIDE))
    while best[j][kind][1]:
        i, before = best[j][kind][1]
        if kind != OUTSIDE:
            out.append((kind, zone.tokens[i][0], zone.tokens[j - 1][1]))
        j, kind = i, before
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    most = max(values)
    return most + log(sum(exp(v - most) for v in values))


def gradient(zone: Zone, gold: set[tuple[int, int, str]], weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """(log-likelihood of the gold segmentation, its gradient) by the forward and backward sums over all segmentations."""
    ends, kinds = _segments(zone, weights)
    n = len(zone.tokens)
    step = {(p, k): weights.get(_step(p, k), 0.0) for p in kinds for k in kinds}
    forward: list[dict[str, float]] = [{OUTSIDE: 0.0}, *({} for _ in range(n))]
    for j in range(1, n + 1):
        sums: dict[str, list[float]] = defaultdict(list)
        for i, kind, _, score in ends[j]:
            sums[kind] += [value + step[p, kind] + score for p, value in forward[i].items()]
        forward[j] = {k: _log_sum(v) for k, v in sums.items()}
    starts: list[list[tuple]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i, kind, features, score in ends[j]:
            starts[i].append((j, kind, features, score))
    backward: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(kinds, 0.0)]
    for i in range(n - 1, -1, -1):
        backward[i] = {p: _log_sum([backward[j][k] + step[p, k] + score for j, k, _, score in starts[i]]) for p in kinds}
    total = backward[0][OUTSIDE]
    out: dict[str, float] = defaultdict(float)
    for j in range(1, n + 1):
        for i, kind, features, score in ends[j]:
            for p, value in forward[i].items():
                share = exp(min(0.0, value + step[p, kind] + score + backward[j][kind] - total))
                out[_step(p, kind)] -= share
                for f in features:
                    out[f] -= share
    value, at, before = -total, 0, OUTSIDE
    spans = {i: (j, k) for i, j, k in gold if (i, j) in zone.spans and k in zone.spans[i, j]}
    while at < n:
        j, kind = spans.get(at, (at + 1, OUTSIDE))
        features = zone.spans[at, j][kind] if kind != OUTSIDE else ()
        for f in (_step(before, kind), *features):
            out[f] += 1
            value += weights.get(f, 0.0)
        at, before = j, kind
    out.pop(_step(OUTSIDE, OUTSIDE), None)  # the scale is free: this step weighs nothing
    return value, out


def examples(n: int, seed: int = 9) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up sentences with their spans."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("an", "er", "th", "on", "is", "lo", "ka", "mi")) for _ in range(rng.randrange(1, 4)))

    def card() -> str:
        own = rng.choice("3456") + digits(14)
        own += next(c for c in "0123456789" if luhn(own + c))
        gap = rng.choice((" ", "-", "."))
        return gap.join(own[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = rng.choice("23456789") + digits(2), digits(3), digits(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{a[:2]} {b} {c}{digits(2)}", f"({a}) {b} {c}", f"0{a} {b}{c}"))

    def email() -> str:
        at = rng.choice(("[at]", "(at)", " at ", " [at] ", " (at) ", "@", " AT "))
        dot = rng.choice((" dot ", "[dot]", "(dot)", " [dot] ", " DOT ", " (dot) ")) if at != "@" or rng.random() < 0.7 else "."
        host = dot.join([word() for _ in range(rng.randrange(1, 3))] + [rng.choice(("com", "org", "net", "de", "io"))])
        local = rng.choice((word(), f"{word()}.{word()}", f"{word()}{digits(2)}"))
        return f"{local}{at}{host}" if at != "@" or dot != "." else f"{local} [at] {host}"

    def ip() -> str:
        gap = rng.choice(("[.]", " . ", "(.)", " [.] ", " dot ", "[dot]", "(dot)", " [dot] ", ". ", " DOT "))
        gaps = [gap if rng.random() < 0.8 else "." for _ in range(2)] + [gap]
        rng.shuffle(gaps)
        parts = [str(rng.choice((rng.randrange(256), rng.randrange(10), 10, 192, 168))) for _ in range(4)]
        return parts[0] + "".join(g + p for g, p in zip(gaps, parts[1:], strict=True))

    def other() -> str:
        y = rng.choice(("19", "20")) + digits(2)
        return rng.choice(
            (f"{y}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{y}", digits(rng.randrange(7, 16)), digits(16), f"{digits(16)}", f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}.{digits(2)}", f"{y} {y} {y}",
             f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(1)}.{digits(4)}-{digits(3)}", f"${digits(3)} {digits(3)} {digits(3)}", f"{digits(2)} - {digits(3)} - {digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}",
             f"{word()} at {word()}. {word().capitalize()}", f"{word()} at {word()}.{word()}", f"{word()} at the dot of {word()}", f"x{digits(8)}y", f"{digits(9)}{word()}{digits(9)}", f"{digits(5)} {digits(5)}", f"{digits(8)}.{digits(6)}",
             ". ".join(digits(rng.randrange(1, 3)) for _ in range(rng.randrange(4, 7))), " . ".join(str(rng.randrange(300, 999)) for _ in range(4)), ". ".join(str(k) for k in range(1, 5)), f"{digits(1)}.{digits(1)}. {digits(1)}.{digits(1)}")
        )

    makers = {"card": card, "phone": phone, "email": email, "ip": ip}
    for _ in range(n):
        kind = rng.choice(("card", "phone", "email", "ip", "", "", "", ""))
        middle = makers[kind]() if kind else other()
        cue = rng.choice(sorted(CUES[kind])) if kind and rng.random() < 0.3 else word()
        left = f"{word()} {cue}{rng.choice((' ', ': ', ' '))}"
        right = rng.choice((f" {word()} {word()}", ".", f", {word()}", "\n", f". {word().capitalize()}", "###", " |"))
        yield left + middle + right, [(kind, len(left), len(left) + len(middle))] if kind else []


def trained(n: int = 2000, epochs: int = 4, rate: float = 0.3, penalty: float = 1e-4) -> dict[str, float]:
    """Weights by feature: gradient ascent on the likelihood, each weight's step shrinking with its own gradients."""
    data = []
    for text, spans in examples(n):
        taken = Taken([s for own in base_spans(text).values() for s in own])
        for start, end in zones(text, taken):
            zone = Zone(text, start, end, taken)
            at = {a: i for i, (a, _) in enumerate(zone.tokens)}
            to = {b: i + 1 for i, (_, b) in enumerate(zone.tokens)}
            data.append((zone, {(at[a], to[b], k) for k, a, b in spans if a in at and b in to}))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-4)
    order = random.Random(1)
    for _ in range(epochs):
        order.shuffle(data)
        for zone, gold in data:
            for f, g in gradient(zone, gold, weights)[1].items():
                g -= penalty * weights[f]
                squares[f] += g * g
                weights[f] += rate * g / squares[f] ** 0.5
    return dict(weights)


def all_spans(text: str, weights: dict[str, float]) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(the patterns' spans, all spans) by kind, in order."""
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    taken = Taken([s for own in base.values() for s in own])
    for start, end in zones(text, taken):
        for kind, a, b in decode(Zone(text, start, end, taken), weights):
            every[kind].append((a, b))
    return base, {k: sorted(set(v)) for k, v in every.items()}


def shown(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def pii(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, the patterns' counts, base_sha256 and spans of each document."""
    prepare(docs.sparkSession)
    weights = weights or trained()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, marks, spans = {k: [] for k in KINDS}, [], []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text or "", weights)
                for k in KINDS:
                    counts[k].append(len(base[k]))
                marks.append(hashlib.sha256(shown(base).encode()).hexdigest())
                spans.append(shown(every))
            columns = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(marks, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
