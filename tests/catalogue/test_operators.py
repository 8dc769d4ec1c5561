import datetime
import json

import pytest
from pyspark.sql import functions as F
from shelfmark.operators import changes, extract, index, match, rank, screen
from shelfmark.sources import readers
from shelfmark.streaming import refresh

LIST = [(1, "Knot, The"), (2, "Twenty Knots"), (3, "Sunflower Field"), (4, "Sun Flower Fields"), (5, "The Grey House"), (6, "Colour of Water")]


@pytest.fixture(scope="module")
def posted(spark):
    rows = spark.createDataFrame([(i, t, None, None) for i, t in LIST], "id bigint, title string, banned_by string, type string")
    return index.postings(rows).cache()


def found(spark, posted, text):
    q = spark.createDataFrame([(1, text)], "query_id int, text string")
    return {r.row_id: r.tier for r in match.search(q, posted).collect()}


def test_search(spark, posted):
    assert found(spark, posted, "the knot") == {1: 3, 2: 3}  # singular and plural
    assert found(spark, posted, "sunfl")[3] == 3  # being typed
    assert found(spark, posted, "sunflower")[4] == 2  # written as two words
    assert found(spark, posted, "sun flower")[3] == 2  # written as one
    assert found(spark, posted, "gray house")[5] == 3 and found(spark, posted, "color water")[6] == 3
    assert found(spark, posted, "hosue")[5] == 2  # two letters swapped
    assert found(spark, posted, "house nothing") == {5: 1}
    assert found(spark, posted, "") == {} and found(spark, posted, "zzzz") == {}


def test_near_terms_against_all_pairs(spark):
    from shelfmark.functions.edits import osa

    words = ["water", "watre", "waters", "otter", "house", "hosue", "mouse", "thousand", "thuosand", "thousnads", "abc", "abd"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.term) for r in match.near_terms(df, df.select(F.col("word").alias("term"))).collect()}
    budget = lambda n: 0 if n <= 3 else 1 if n <= 7 else 2
    want = {(a, b) for a in words for b in words if a != b and min(len(a), len(b)) > 3 and (a[0] == b[0] or a[1] == b[1]) and osa(a, b, budget(min(len(a), len(b)))) <= budget(min(len(a), len(b)))}
    assert got == want and ("house", "hosue") in got


def test_joins_have_something_to_block_on(spark, posted):
    q = spark.createDataFrame([(1, "red water")], "query_id int, text string")
    plan = match.search(q, posted)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rank_and_cut(spark):
    rows = [(1, k, 3 if k < 3 else 1, 1, 1, 0, "ab"[k % 2]) for k in range(8)]
    df = spark.createDataFrame(rows, "query_id int, row_id int, tier int, strong int, anchors int, quality int, group_key string")
    placed = rank.gathered(rank.ranked(df))
    order = [r.row_id for r in placed.orderBy("place").collect()]
    assert order == [0, 2, 4, 6, 1, 3, 5, 7]
    assert sorted(r.row_id for r in rank.cut(placed, 2).collect()) == [0, 2, 4, 6]  # no group is split


def test_screening_by_isbn_and_titles_inside(spark):
    items = [(1, "A", "The Red Knot and other tales", "Someone", None), (2, "A", "", None, "9780374371524"), (3, "A", "Knot red", "", ""), (4, "A", "A knot", "", ""), (4, "A", "A knot", "", ""), (5, "A", None, None, None)]
    rows = [(1, "Red Knot", "Writer", ""), (2, "Red Knot", "Writer", ""), (3, "Other", "", "9780374371524"), (4, "Knot", "", "")]
    found = screen.verdicts(
        spark.createDataFrame(items, "item_id int, tab string, title string, author string, isbn string"),
        spark.createDataFrame(rows, "row_id int, title string, author string, isbn string"),
    )
    assert sorted((r.item_id, r.verdict, r.likely, r.look) for r in found.collect()) == [(1, "look", 0, 2), (2, "likely", 1, 0), (3, "look", 0, 2), (4, "likely", 1, 0), (4, "likely", 1, 0), (5, "skipped", 0, 0)]


def test_screening(spark):
    items = [(1, "A", "The Knot (copies)", ""), (2, "A", "knot", "Someone"), (3, "B", "!!", ""), (4, "B", "Other", ""), (5, "B", "Knot", "Writer")]
    found = screen.verdicts(
        spark.createDataFrame(items, "item_id int, tab string, title string, author string"),
        spark.createDataFrame([(1, "Knot, The", "Writer")], "row_id int, title string, author string"),
    )
    assert {r.item_id: r.verdict for r in found.collect()} == {1: "likely", 2: "look", 3: "skipped", 4: "clear", 5: "likely"}
    assert {r.tab: (r.items, r.likely, r.look) for r in screen.report(found).collect()} == {"A": (2, 1, 1), "B": (3, 1, 0), "*": (5, 2, 1)}


CSV = 'Banned list\r\n"Updated, May 2024"\r\nTitle,Author(s),Banned By,Year of banning,Shelf\r\nKnot,Someone,Ministry,2010/11,x\r\n\r\nAdditions 2024-2025,,,,\r\n"Two\nlines",A. B.,KES,2012,\r\nTitle,Author(s),Banned By,Year of banning,Shelf\r\nPasted +3:15A13:2,C,uas,,\r\n'


def test_csv_to_list(spark, tmp_path):
    assert readers.parse_csv("﻿a,\"b\"\"c\",\n\r\nx\"y\r") == [["a", 'b"c', ""], [""], ['x"y']]
    assert readers.parse_csv("") == [] and readers.parse_csv(None) == []
    (tmp_path / "one.csv").write_text(CSV, newline="")
    records = readers.read_csv_tabs(spark, {"One": f"file://{tmp_path}/one.csv"})
    header = extract.find_header(records)
    assert (header.row, header.updated_as_of, header.banner) == (3, "Updated, May 2024", "Banned list")
    assert header.columns == {"title": 0, "author": 1, "banned_by": 2, "year": 3}
    rows, issues = extract.extract(records, header)
    got = {r.row: r for r in rows.collect()}
    assert {k: (r.title, r.section, r.status.level) for k, r in got.items()} == {
        4: ("Knot", None, "ministry"), 7: ("Two\nlines", "Additions 2024-2025", "other"), 9: ("Pasted +3:15A13:2", "Additions 2024-2025", "uas"),
    }
    assert [(e.header, e.value) for e in got[4].extra] == [("Shelf", "x")] and got[4].fingerprint == "knot\u001fsomeone\u001fministry\u001f2010/11"
    assert sorted((r.row, r.kind) for r in issues.collect()) == [(6, "sectionHeading"), (8, "repeatedHeader"), (9, "pasteResidue")]
    assert extract.find_header(records.filter("row > 3 and row < 8")) is None


def test_script_and_grid_json(spark):
    tab = {"name": "T", "gid": "7", "headerRow": 2, "headers": ["Title"], "rows": [{"row": 3, "values": ["Knot"], "hidden": True}]}
    good = json.dumps({"format": "list-v1", "spreadsheetId": "s", "tabs": [tab], "errors": [{"tab": "U", "message": "gone"}]})
    records, errors = readers.script_tables(spark.createDataFrame([(good,), ("{}",), ("no json",)], "json string"))
    assert sorted((r.row, r.cells[0], r.hidden) for r in records.collect()) == [(2, "Title", None), (3, "Knot", True)]
    assert sorted((r.tab or "", r.message) for r in errors.collect()) == [("", "not a list"), ("", "not a list"), ("U", "gone")]
    v = lambda *x: {"values": [{"formattedValue": c} if c else {} for c in x]}
    grid = {"sheets": [{"properties": {"sheetId": 1, "title": "G"}, "merges": [{"startRowIndex": 1, "endRowIndex": 3, "startColumnIndex": 1, "endColumnIndex": 2}], "data": [{"rowMetadata": [{}, {}, {"hiddenByUser": True}], "rowData": [v("Title", "By"), v("One", "M"), v("Two")]}]}]}
    out = {r.row: (r.cells, r.hidden) for r in readers.grid_records(spark.createDataFrame([(json.dumps(grid),)], "json string")).collect()}
    assert out == {1: (["Title", "By"], False), 2: (["One", "M"], False), 3: (["Two", "M"], True)}
    names = readers.aliases(spark.createDataFrame([('{"aliases":[{"kind":"a","names":["x","y"]}]}',), ("?",)], "json string"))
    assert sorted(map(tuple, names.collect())) == [(0, "x"), (0, "y")]


def test_versions(spark):
    schema = "tab string, fingerprint string, row int"
    old = spark.createDataFrame([("t", "a", 1), ("t", "a", 5), ("t", "b", 2)], schema)
    new = spark.createDataFrame([("t", "a", 2), ("t", "c", 9), ("u", "a", 1)], schema)
    got = {(r.tab, r.fingerprint, r.nth, r.old_row, r.new_row) for r in changes.paired(old, new).collect()}
    assert got == {("t", "a", 1, 1, 2), ("t", "a", 2, 5, None), ("t", "b", 1, 2, None), ("t", "c", 1, None, 9), ("u", "a", 1, None, 1)}
    assert sorted(r.tab for r in changes.changed_tabs(old, new, ["fingerprint", "row"]).collect()) == ["t", "u"]
    assert changes.changed_tabs(old, old.orderBy(F.desc("row")), ["fingerprint", "row"]).count() == 0


def test_stream_keeps_the_last_good_version(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    schema = "tab string, title string"

    def turn(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{source}")
        stream = spark.readStream.schema(schema).json(f"file://{source}")
        refresh.keep_latest(stream, out, f"file://{tmp_path}/cp").awaitTermination(60)
        return sorted((r.tab, r.title) for r in spark.read.parquet(out).collect())

    assert turn([("a", "one"), ("b", "two")]) == [("a", "one"), ("b", "two")]
    assert turn([("a", "three")]) == [("a", "three"), ("b", "two")]


def test_event_windows(spark):
    at = datetime.datetime(2024, 1, 1, 5, 10)
    df = spark.createDataFrame([(at, "x"), (at + datetime.timedelta(minutes=20), "x"), (at + datetime.timedelta(hours=1), "y")], "ts timestamp, event_type string")
    assert sorted((r.event_type, r.n) for r in refresh.counted(df).collect()) == [("x", 2), ("y", 1)]
