from pyspark.sql import functions as F
from shelfmark.operators import judge, screen
from shelfmark.plans import catalogue

ROWS = [(1, "Red Knot", "Ann Lee", "111"), (2, "Goosebumps series", "R. L. Stine", None), (3, "Sunflower Field", None, None), (4, "The Old Red Knot", "Bo King", None), (5, None, None, None), (6, "", "x", "222")]
ROWS += [(k, "Many Copies", "", None) for k in range(10, 19)]
ITEMS = [
    (1, "A", "red knot", "ann lee", None), (2, "A", "Red Knot", "Bo", None), (3, "A", "Sunflwoer Field", "Anyone", None), (4, "A", "goosebumps say cheese", None, None), (5, "B", "many copies", "Someone", None),
    (6, "B", "Manny Copies", "Someone", None), (7, "B", "nothing like it", None, None), (8, "B", None, None, "222"), (9, "B", "Red Knots", "Bo King", None), (10, "B", "!", "", ""), (11, "B", "tales of the red knot", "", None), (1, "A", "red knot", "ann lee", None),
]


def found(spark, items, rows):
    listed = spark.createDataFrame(rows, "row_id int, title string, author string, isbn string")
    series = judge.series_names(listed.select("row_id", "title"), F.coalesce(F.lower("title").contains("series"), F.lit(False)))
    asked = spark.createDataFrame(items, "item_id int, tab string, title string, author string, isbn string")
    return screen.findings(asked, listed, series), asked, listed


def test_five_best_rows_of_each_item(spark):
    out, asked, listed = found(spark, ITEMS, ROWS)
    got = {}
    for r in out.collect():
        got.setdefault(r.item_id, []).append((r.place, r.row_id, screen.REASONS[r.reason], r.strength, r.more))
    got = {k: sorted(v) for k, v in got.items()}
    assert got[1] == [(1, 1, "title and author match", "likely", 0)] * 2  # a repeated item is one of its own
    assert got[2] == [(1, 1, "same title, different author", "look", 0)]
    assert got[3] == [(1, 3, "similar title", "look", 0)]
    assert got[4] == [(1, 2, "the listing covers the whole series", "likely", 0)]
    assert [(p, i, more) for p, i, *_, more in got[5]] == [(k + 1, 10 + k, 4) for k in range(5)] and got[5][0][2:4] == ("same title", "likely")
    assert [x[2] for x in got[6]] == ["similar title"] * 5
    assert got[8] == [(1, 6, "same ISBN", "likely", 0)]
    assert 9 not in got  # only resembles a title, by an author the list doesn't give for it
    assert got[11] == [(1, 1, "a listed title is in this one", "look", 0)]
    assert 7 not in got and 10 not in got
    lines = {(r.item_id, r.listed, r.result) for r in screen.result_grid(out.filter("item_id = 5"), asked, listed).collect()}
    assert lines == {(5, "Many Copies", "Likely banned"), (5, "…and 4 more", "Likely banned")}


def test_misspelt_against_all_pairs(spark):
    from shelfmark.functions.edits import osa

    words = ["sunflower", "sunflwoer", "field", "feild", "fields", "red", "rod", "knot", "knto", "knots"]
    titles = [f"{a} {b}" for a in words[:4] for b in words[2:]] + words
    frame = lambda name: spark.createDataFrame([(t,) for t in titles], f"{name} string")
    got = {tuple(r) for r in screen.misspelt(frame("key"), frame("similar")).collect()}
    most = lambda a, b: 0 if min(len(a), len(b)) < 4 else 1 if min(len(a), len(b)) <= 7 else 2
    want = set()
    for a in titles:
        for b in titles:
            x, y = a.split(), b.split()
            other = [(p, q) for p, q in zip(x, y, strict=False) if p != q]
            if len(x) == len(y) and len(other) == 1:
                p, q = other[0]
                if (p[0] == q[0] or p[1:2] == q[1:2]) and most(p, q) and osa(p, q, most(p, q)) <= most(p, q):
                    want.add((a, b))
    assert got == want and want


def test_empty(spark):
    assert found(spark, [], ROWS)[0].count() == 0 and found(spark, ITEMS, [])[0].count() == 0


def test_every_part_is_asked_by_its_isbn_start(spark, tmp_path):
    keys = [*range(1, 12), 50, 51, 100, 101, 556, 123_501, 1_000_000_001]  # 123501 begins as 556 does in thirteen digits; the last has the core of 1
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in catalogue.isbn_prefix_search(spark, str(tmp_path)).collect()}
    core = {k: f"{k * 7919 % 1_000_000_000:09d}" for k in keys}
    assert {(c[:7], k) for k, c in core.items()} <= got
    assert got == {(a[:7], k) for a in core.values() for k, b in core.items() if b.startswith(a[:7]) or f"978{b}".startswith(a[:7])}
