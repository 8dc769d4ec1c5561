import hashlib
import itertools
import random
import re
from math import exp, log

import pytest
from shelfmark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        twice = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(d[::-1])]
        return sum(x // 10 + x % 10 for x in twice) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


@pytest.fixture(scope="module")
def weights():
    return pii.trained()


def test_patterns_against_plain_regexes():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", "x.y-z@h", ".com", "1.2.3.4", "256.1.1.1", ".", "4111 1111 1111 1111", "-", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "é", "007.010.0.1", "12", "(", ")", "@@", "5500005555555559"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_field_adds_what_the_patterns_miss(weights):
    right = total = 0
    for text, spans in pii.examples(400, seed=1234):
        base, every = pii.all_spans(text, weights)
        assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)
        kept = {s for own in base.values() for s in own}
        right += {(k, *s) for k in pii.KINDS for s in every[k] if s not in kept} == {s for s in spans if s[1:] not in kept}
        total += 1
    assert right >= 0.97 * total


def test_plain_text_is_left_alone(weights):
    for text in ("In 2015 we met at noon. Then 1,234 of them", "version 1.2.3 of 2020-11-26", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "pages 12-19, 30 40 50"):
        assert pii.shown(pii.all_spans(text, weights)[1]) == ""


def test_addresses_spelled_out(weights):
    for text, own in {"server 192.168.1[.]1 is up": "192.168.1[.]1", "ip 10[.]20[.]0[.]1": "10[.]20[.]0[.]1", "host 172 dot 16 dot 3 dot 200 ok": "172 dot 16 dot 3 dot 200", "from 10 . 24 . 0 . 18, it": "10 . 24 . 0 . 18"}.items():
        at = text.index(own)
        assert pii.all_spans(text, weights)[1]["ip"] == [(at, at + len(own))], text
    for text in ("999 . 300 . 400 . 500", "see 1. 2. 3. 4 of the list", "sections 3.1. 3.2. 3.3"):
        assert pii.shown(pii.all_spans(text, weights)[1]) == "", text
    long = "john.smith99 [at] mail [dot] example [dot] co [dot] uk"
    assert pii.all_spans(f"to {long} now", weights)[1]["email"] == [(3, 3 + len(long))]


def test_gradient_against_differences(weights):
    text = "ip 10[.]20[.]0[.]18 call (212) 555-0147 4111.1111.1111.1111"
    own = dict(weights)
    for span in pii.zones(text, pii.Taken([])):
        zone = pii.Zone(text, *span, pii.Taken([]))
        gold = {(i, j, k) for (i, j), kinds in sorted(zone.spans.items())[:1] for k in kinds if k != "phone"}
        _, grads = pii.gradient(zone, gold, own)
        for f in sorted(grads, key=lambda f: -abs(grads[f]))[:8]:
            values = [pii.gradient(zone, gold, own | {f: own.get(f, 0.0) + d})[0] for d in (1e-4, -1e-4)]
            assert abs((values[0] - values[1]) / 2e-4 - grads[f]) < 1e-3, f


def test_decoding_and_gradient_against_all_segmentations(weights):
    text = "call (212) 555-0147 4111.1111.1111.1111"
    (span,) = pii.zones(text, pii.Taken([]))
    zone = pii.Zone(text, *span, pii.Taken([]))
    spans = [(i, j, k, sum(weights.get(f, 0) for f in fs)) for (i, j), kinds in zone.spans.items() for k, fs in kinds.items()]
    spans = sorted(spans, key=lambda s: -s[3])[:14]
    keep = {(i, j, k) for i, j, k, _ in spans}
    zone.spans = {ij: own for ij in zone.spans if (own := {k: fs for k, fs in zone.spans[ij].items() if (*ij, k) in keep})}
    scores = []
    for r in range(4):
        for some in itertools.combinations(spans, r):
            if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)):
                at, before, total = 0, pii.OUTSIDE, 0.0
                starts = {s[0]: s for s in some}
                while at < len(zone.tokens):
                    _, to, kind, score = starts.get(at, (at, at + 1, pii.OUTSIDE, 0.0))
                    total, at, before = total + score + weights.get(f"{before}>{kind}", 0.0), to, kind
                scores.append((total, some))
    best = max(scores, key=lambda x: x[0])
    got = pii.decode(zone, weights)
    assert {(k, a, b) for k, a, b in got} == {(k, zone.tokens[i][0], zone.tokens[j - 1][1]) for i, j, k, _ in best[1]}
    value, _ = pii.gradient(zone, set(), weights)
    assert abs(value + log(sum(exp(s) for s, _ in scores))) < 0.05


def test_rows(spark, weights):
    rows = [(1, "mail a@b.co or 10.0.0.1", 5), (1, None, 6), (None, "", 7), (2, "é" * 5000 + " +1 (555) 123-4567", 8)]
    out = pii.pii(spark.createDataFrame(rows, "doc_id bigint, text string, spans int"), weights).collect()
    found = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in out}
    assert found == {(1, 1, 1, 0, 0, "email:5:11,ip:15:23"), (1, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, ""), (2, 0, 0, 0, 1, "phone:5001:5018")}
    assert {r.base_sha256 for r in out if not r.spans} == {hashlib.sha256(b"").hexdigest()}
    assert pii.pii(spark.createDataFrame([], "doc_id bigint, text string"), weights).count() == 0


def test_very_long_texts_take_linear_time(weights):
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1 " * 2000, "1." * 3000, "+1(" * 3000, " at dot" * 2000):
        pii.all_spans(text, weights)
