import random

from pyspark.sql import functions as F
from shelfmark.operators import changes, highlight, judge, linediff


def nearest(old, new):
    free, out = list(new), []
    for row in old:
        best = min(free, key=lambda x: (abs(x - row), x), default=None)
        out.append(best)
        if best is not None:
            free.remove(best)
    return out


def test_nearest_free_rows():
    drawn = random.Random(2)
    for _ in range(400):
        old, new = (sorted(drawn.sample(range(30), drawn.randrange(0, 12))) for _ in range(2))
        assert changes._nearest(old, new) == nearest(old, new)
    n = 200_000
    assert changes._nearest(list(range(n)), list(range(n, 2 * n + 1))) == list(range(n, 2 * n))


def test_paired_nearest(spark):
    drawn = random.Random(3)
    versions = [[(t, f, r) for t in "ab" for r in range(40) for f in [drawn.choice(["x", "y", "z", None])] if drawn.random() < 0.6] for _ in range(2)]
    old, new = (spark.createDataFrame(v, "tab string, fingerprint string, row int") for v in versions)
    got = {tuple(r) for r in changes.paired_nearest(old.filter("fingerprint is not null"), new.filter("fingerprint is not null")).collect()}
    want = set()
    for t in "ab":
        for f in "xyz":
            a, b = ([r for x, y, r in v if (x, y) == (t, f)] for v in versions)
            taken = b if len(a) == len(b) else nearest(a, b)
            want |= {(t, f, *p) for p in zip(a, taken, strict=True)} | {(t, f, None, r) for r in b if r not in taken}
    assert got == want


def test_signature_sees_any_change(spark):
    a = spark.createDataFrame([("t", "x", 1), ("t", "x", 1), ("u", None, 2)], "tab string, title string, row int")
    b = spark.createDataFrame([("t", "x", 1), ("u", None, 2)], "tab string, title string, row int")
    assert [r.tab for r in changes.changed_tabs(a, b, ["title", "row"]).collect()] == ["t"]
    assert changes.changed_tabs(a, a.orderBy(F.desc("tab")), ["title", "row"]).count() == 0


def by_table(old, new):
    n, m = len(old), len(new)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_line_diff_against_the_whole_table():
    drawn = random.Random(6)
    for _ in range(300):
        old, new = ([drawn.choice("abcd") for _ in range(drawn.randrange(0, 12))] for _ in range(2))
        steps = linediff._steps(old, new)
        assert [t for op, t, *_ in steps if op != "add"] == old and [t for op, t, *_ in steps if op != "del"] == new
        assert sum(op == "same" for op, *_ in steps) == by_table(old, new)
        assert all((a is None or old[a - 1] == t) and (b is None or new[b - 1] == t) for _, t, a, b in steps)
    assert [op for op, *_ in linediff._steps(list("xay"), list("xby"))] == ["same", "del", "add", "same"]
    wide = linediff._steps(["x", *map(str, range(3000)), "y"], ["x", *map(str, range(1, 3001)), "y"])
    assert [op for op, *_ in wide].count("same") == 2  # too many cells: all removed, then all added


def test_hunks(spark):
    old = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf\ng\nh\ni\n"), (2, "same"), (3, None), (4, "x")], "tab int, text string")
    new = spark.createDataFrame([(1, "a\nB\nc\nd\ne\nf\ng\nh\n"), (2, "same"), (3, "new"), (5, "y\n\n")], "tab int, text string")
    steps = linediff.line_diff(old, new)
    found = {}
    for r in linediff.hunks(steps, 1).orderBy("tab", "step").collect():
        found.setdefault((r.tab, r.hunk), []).append(r.op[0] + r.text)
    assert found == {(1, 0): ["sa", "db", "aB", "sc"], (1, 1): ["sh", "di"], (3, 0): ["anew"], (4, 0): ["dx"], (5, 0): ["ay", "a"]}


def test_highlights(spark):
    rows = spark.createDataFrame([(1, "The Sandcastle's Étude", "O'Brien, J."), (2, "Twenty-One Knots", None), (3, "Sand Castle of the King", None), (4, None, None)], "row_id int, title string, author string")
    ranges = highlight.word_ranges(rows)
    own = {(r.row_id, r.field, r.word): (r.s, r.e) for r in ranges.collect()}
    assert own[1, "title", "sandcastles"] == (4, 16) and own[1, "title", "etude"] == (17, 22) and own[1, "author", "obrien"] == (0, 7)
    asked = spark.createDataFrame([(0, 0, "sandc"), (1, 0, "the"), (1, 1, "sandcastle"), (2, 0, "sandcastle"), (3, 0, "of"), (3, 1, "king"), (3, 2, "the"), (4, 0, "obr")], "query_id int, unit int, word string")
    units = judge.described(asked)
    hits = spark.createDataFrame(
        [(0, 1, 0, "title", 1, "prefix"), (1, 1, 0, "title", 0, "exact"), (1, 1, 1, "title", 1, "alt"), (1, 1, 1, "author", 0, "edit1"), (2, 3, 0, "title", 0, "compound"),
         (3, 3, 0, "title", 2, "exact"), (3, 3, 1, "title", 4, "exact"), (3, 3, 2, "title", 3, "exact"), (4, 1, 0, "author", 0, "prefix")],
        "query_id int, row_id int, unit int, field string, wi int, kind string",
    )
    got = {}
    for r in highlight.highlights(units, hits, ranges).collect():
        got.setdefault(r.query_id, []).append((r.row_id, r.field, r.s, r.e))
    assert got[0] == [(1, "title", 4, 9)]  # as far as it was typed
    assert sorted(got[1]) == [(1, "title", 0, 3), (1, "title", 4, 16)]  # the small word beside it, and no weaker hit
    assert got[2] == [(3, "title", 0, 11)]  # both words of what was typed as one
    assert sorted(got[3]) == [(3, "title", 15, 18), (3, "title", 19, 23)]  # "of" stands beside no marked word
    assert got[4] == [(1, "author", 0, 4)]  # the apostrophe within it counts


def test_marked(spark):
    rows = [("abcdef", [(4, 9), (1, 2), (2, 3), (5, 5)]), ("abc", []), ("", [(0, 3)]), ("日本語é", [(-5, 1), (3, 4)]), ("abc", [(0, 3), (1, 2)])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<s:int,e:int>>")
    got = [[(p.text, p.mark) for p in r.parts] for r in df.select(highlight.marked(F.col("text"), F.col("spans")).alias("parts")).collect()]
    assert got == [[("a", False), ("bc", True), ("d", False), ("ef", True)], [("abc", False)], [], [("日", True), ("本語", False), ("é", True)], [("abc", True)]]
