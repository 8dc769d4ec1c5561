import random
import re

from pyspark.sql import functions as F
from shelfmark.functions import isbn
from shelfmark.operators import labels
from shelfmark.sources import readers


def test_ranges_of_a_title(spark):
    rows = [(1, "Knots Books 1-50"), (2, "Knots, Vol. 4"), (3, "grades 3 to Grade 5; Book #7"), (4, "Room 12, no. 9"), (5, "Book 9-2"), (6, None), (7, ""), (8, "2024-25"), (9, "Book 1 through 1000000")]
    got = labels.ranges(spark.createDataFrame(rows, "row_id int, title string"), "title").collect()
    assert {(r.row_id, r.label, r.low, r.high) for r in got} == {(1, "book", 1, 50), (2, "book", 4, 4), (3, "grade", 3, 5), (3, "book", 7, 7), (4, "book", 9, 9), (5, "book", 9, 9), (9, "book", 1, 1)}


def test_label_hits_against_all_pairs(spark):
    drawn = random.Random(1)
    listed = [(k, drawn.choice(["book", "grade"]), a, a + drawn.choice([0, 0, 5, 300, 5000])) for k in range(80) for a in [drawn.randrange(1000)]]
    asked = [(k, drawn.choice(["book", "grade"]), a, a + drawn.choice([0, 0, 100])) for k in range(20) for a in [drawn.randrange(1200)]]
    near = [(q, r) for q in range(20) for r in range(80) if drawn.random() < 0.3]
    out = labels.label_hits(
        spark.createDataFrame(asked, "query_id int, label string, low int, high int"), spark.createDataFrame(listed, "row_id int, label string, low int, high int"), spark.createDataFrame(near, "query_id int, row_id int")
    )
    got = {tuple(r) for r in out.select("query_id", "row_id", "label", "kind").collect()}
    exact = {(q, r, a) for q, a, low, high in asked for r, b, x, y in listed if a == b and low <= y and x <= high}
    of = {q: a for q, a, *_ in asked}
    loose = {(q, r, of[q]) for q, r in near if listed[r][1] == of[q]} - exact
    assert got == {(*x, "exact") for x in exact} | {(*x, "loose") for x in loose}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_failures_stay_with_their_tab(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"one.csv": 'Title\n"a\nb"\n', "sub/two.csv": " \n\n", "sub/web.csv": "\n<HTML><body>", "xone.csv": "Title\n"}.items():
        (tmp_path / name).write_text(text)
    paths = {"One": "one.csv", "Two": "sub/two.csv", "Web": "web.csv", "Gone": "gone.csv", "Root": "two.csv"}
    records, errors = readers.load_csv_tabs(spark, str(tmp_path), paths)
    assert sorted((r.tab, r.row, r.cells) for r in records.collect()) == [("One", 1, ["Title"]), ("One", 2, ["a\nb"])]
    assert sorted((r.tab, r.kind) for r in errors.collect()) == [("Gone", "missing"), ("Root", "empty"), ("Two", "empty"), ("Web", "html")]


def test_results_hold_no_formulas(spark, tmp_path):
    readers.write_csv(spark.createDataFrame([("=1+1", -1), ("plain", 2), (None, 3)], "title string, n int").coalesce(1), str(tmp_path / "out"))
    got = {tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()}
    assert got == {("'=1+1", "-1"), ("plain", "2"), (None, "3")}


def numbers(text):
    """The leftmost numbers, thirteen digits before ten, by trying every start."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(?:[xX](?![A-Za-z]))?|(?<=[0-9][ -])[xX](?![A-Za-z])", text)]
    out, k = [], 0
    while k < len(groups):
        ways = []
        for last in range(k, len(groups)):
            if any(text[groups[j][1] : groups[j + 1][0]] not in (" ", "-") for j in range(k, last)):
                break
            digits = "".join(text[a:b] for a, b in groups[k : last + 1]).lower()
            if re.fullmatch("97[89][0-9]{10}|[0-9]{9}[0-9x]", digits):
                ways.append((len(digits), last, digits))
        if not ways and re.fullmatch("[0-9]{9}", text[slice(*groups[k])]):
            ways = [(9, k, "0" + text[slice(*groups[k])])]
        if ways:
            _, last, digits = max(ways)
            out.append((digits, groups[k][0], groups[last][1]))
            k = last
        k += 1
    return out


def test_isbn_scan_against_every_start():
    drawn = random.Random(9)
    for _ in range(4000):
        parts = [drawn.choice(["978", "979", "0", "81", "7450", "835", "X", "x", "123456789", "0374371524", "9780374371524", "0306406152", "abc", "1"]) for _ in range(drawn.randrange(1, 9))]
        text = "".join(p + drawn.choice([" ", "-", "-", "", ", ", "  "]) for p in parts)
        assert isbn.scan(text) == numbers(text), text


def test_spans_are_found_by_columns(spark):
    got = spark.createDataFrame([("978-0-374-37152-4 and 123456789",), (None,)], "t string").select(F.transform(isbn.scan_udf(F.col("t")), lambda x: x["digits"]).alias("d")).collect()
    assert [r.d for r in got] == [["9780374371524", "0123456789"], []]
