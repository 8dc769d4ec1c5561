import random
import re
from collections import Counter, defaultdict

import numpy as np
from shelfmark.llm import divergence

SCALE = 10**9


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(rows, min_docs, top):
    rows = [(x or "", lang or "", source or "") for x, lang, source in rows]
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        own = terms(text)
        docs[lang].update(set(own))
        counts[lang, source].update(own)
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        at = lambda c: (lambda n: {t: 1 + SCALE * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))  # noqa: E731, B023
        whole, share = at(sum((counts[lang, s] for s in own), Counter())), {s: at(counts[lang, s]) for s in own}
        f = lambda p, q: (p - q) ** 2 // q
        for s in own:
            p = share[s]
            pairs = [(o, sum(f(p[t], share[o][t]) for t in kept)) for o in own if o != s]
            best = [(t, f(p[t], whole[t])) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def drawn_rows(seed, n):
    drawn = random.Random(seed)
    words = ["a", "A", "b", "é", "É", "日本", "\U0001f389", "ſ", "K", "x1y", "z_z", "don't"] + ["w" + chr(97 + k % 26) * (k // 26 + 1) for k in range(60)]
    rows = []
    for _ in range(n):
        text = drawn.choice([" ", "\n", "\x00", ", "]).join(drawn.choices(words, k=drawn.randrange(30)))
        rows.append((text, drawn.choice(["en", "en", "en", "de", None, "", "x\ty"]), drawn.choice(["s1", "s2", "S2", "é", None, "", "z"])))
    return rows + [(None, "only", "s"), ("", "only", "t"), ("one two", "lone", "s"), (None, None, "null text")] + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "text string, lang string, source string, term int, item string, count string")


def test_against_brute_force(spark):
    rows = drawn_rows(1, 300)
    out = divergence.divergence(frame(spark, rows).repartition(3))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == brute(rows, 3, 200)


def test_small_shards_batches_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 20)
    monkeypatch.setattr(divergence, "PENDING", 50)
    monkeypatch.setattr(divergence, "BLOCK", 8)
    rows = drawn_rows(2, 200)
    assert sorted(map(tuple, divergence.divergence(frame(spark, rows).repartition(4), min_docs=2, top=4).collect())) == brute(rows, 2, 4)


def test_no_term_stays(spark):
    rows = [("a b", "en", "s"), ("c", "en", "t"), (None, "en", "u")]
    out = sorted(map(tuple, divergence.divergence(frame(spark, rows)).collect()))
    assert out == brute(rows, 3, 200) and len(out) == 6 and not any(r[4] for r in out)


def test_shares_of_large_counts_are_exact():
    drawn = random.Random(4)
    totals = [drawn.randrange(1, 10 ** drawn.randrange(1, 16)) for _ in range(500)]
    counts = [drawn.choice([0, n - 1, drawn.randrange(n)]) for n in totals]
    own = divergence._shares(np.array(counts), np.array(totals))
    assert own.tolist() == [1 + SCALE * (c + 1) // n for c, n in zip(counts, totals, strict=True)]


def test_very_long_text(spark):
    rows = [("the cat sat on the mat " * 200_000, "en", "long"), ("the cat", "en", "s"), ("cat the dog", "en", "s"), ("the dog", "en", "t")]
    assert sorted(map(tuple, divergence.divergence(frame(spark, rows), min_docs=1).collect())) == brute(rows, 1, 200)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
