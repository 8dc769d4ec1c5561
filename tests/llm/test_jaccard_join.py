import random
from collections import Counter

import numpy as np
from shelfmark.llm import components, jaccard_join


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(texts, threshold=0.8):
    sets, root, links = [shingles(t) for t in texts], list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))], links


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", " \n", "a b", "a  b", "a b c d e", "x"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    base = [rng.choice(words) for _ in range(200)]
    texts += [" ".join([*base[:k], "changed", *base[k:]]) for k in range(70)]  # one large group of near copies
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    rows = [(k if k != 9 else None, t, k) for k, t in enumerate(texts)] + [(3, "a b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, links int").repartition(3)
    root, links = brute([t for _, t, _ in rows])
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, 1 << 60))
    expected = Counter((i, least.get(r), n) for (i, _, _), r, n in zip(rows, root, links, strict=True))
    for block in (16, 256):  # with and without large clusters
        out = jaccard_join.jaccard_join(docs, block=block).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == expected
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) == len(set(root))
    assert Counter(r.doc_id for r in found) == Counter(least.get(r) for r in set(root))


def test_empty_table(spark):
    assert jaccard_join.jaccard_join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    least = jaccard_join.minimum_matches(0.8, jaccard_join.TOLERANCE)
    for share, low, high in ((0.8, 0.998, 1.0), (0.3, 0.0, 0.001)):
        hits = rng.random((20_000, jaccard_join.HASHES)) < share
        stays = np.ones(len(hits), bool)
        for n, fewest in least:
            stays &= hits[:, :n].sum(axis=1) >= fewest
        assert low <= stays.mean() <= high


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100), (100, 100)], "u bigint, v bigint")
    out = dict(components.components(edges).collect())
    assert out == {k: 0 for k in range(61)} | {100: 100, 200: 100}


def test_no_name_of_a_column_clashes(spark):
    names = ["row_file", "row_index", "row", "a", "b", "copies", "head", "root", "first", "class_id", "n_links", "q`u.o te"]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    rows = [(k, "one two three four five six seven" if k % 2 else f"w{k} x y z a b c", *(f"{c} {k}" for c in names)) for k in range(5)]
    out = jaccard_join.deduplicated(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", *names]
    assert sorted(map(tuple, out.collect())) == [r for r in rows if r[0] != 3]


def test_components_are_whole_or_an_error(spark):
    import pytest

    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "u int, v int").repartition(3)
    assert {r.root for r in components.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components.components(edges, most_rounds=1)
