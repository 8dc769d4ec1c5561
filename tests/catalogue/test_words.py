import pytest
from shelfmark.functions import isbn, links, people, words
from shelfmark.operators import explain, index, match, rules


def forms(text):
    return [(w.text, [t for t, _ in w.others]) for w in words.analyzed(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Aaron's", [("aarons", ["aaron"])]), ("O'Brien", [("obrien", ["brien"])]), ("Don't", [("dont", [])]),
        ("R.L. Stine", [("rl", []), ("stine", [])]), ("r l", [("rl", [])]), ("Plan B", [("plan", []), ("b", [])]), ("a b", [("a", []), ("b", [])]), ("A. A. Milne", [("aa", []), ("milne", [])]),
        ("10-Minute", [("10", ["10minute"]), ("minute", [])]), ("covid19", [("covid", ["covid19"]), ("19", [])]), ("2012-2013", [("2012", []), ("2013", [])]), ("9/11", [("9", ["911"]), ("11", [])]),
        ("Seventh", [("seventh", ["7th", "7"])]), ("nineteen eighty-four", [("nineteen", ["19", "1984"]), ("eighty", ["eightyfour", "80"]), ("four", ["4"])]),
    ],
)
def test_analyzed(text, found):
    assert forms(text) == found


def test_terms_hold_pairs():
    assert {t for t, _, _ in words.terms("Class VIII, Books 4 to 6")} >= {"#grade8", "#book4", "#book5", "#book6", "8", "viii"}
    assert words.terms(None) == []


def test_full_index_finds_numbers(spark):
    rows = spark.createDataFrame([(1, "Nineteen Eighty-Four"), (2, "The 7th Knot"), (3, "R. L. Tales")], "id int, title string")
    posted = index.full_postings(rows)
    q = spark.createDataFrame([(1, "1984"), (2, "seventh knot"), (3, "rl tales")], "query_id int, text string")
    got = {(r.query_id, r.row_id): r.tier for r in match.search(q, posted).collect()}
    assert got[1, 1] == 3 and got[3, 3] == 3 and (2, 2) in got


@pytest.mark.parametrize(
    ("author", "names"),
    [("King, Stephen", ["King"]), ("Jack Canfield, Mark Victor Hansen", ["Canfield", "Hansen"]), ("J. K. Rowling & Dr. Seuss", ["Rowling", "Seuss"]), ("King, Martin Luther, Jr.", ["King"]), ("A. Lee (editor) et al.", ["Lee"]), (None, [])],
)
def test_surnames(author, names):
    assert people.surnames(author) == names


def test_series_and_notes():
    assert people.covers_series("Knot: The Complete Series") and people.covers_series("All titles") and not people.covers_series("A series of knots") and not people.covers_series("Knot Series 3")
    assert people.notes("Knot Books 1 to 3") == ["Covers Books 1–3"] and people.notes("Knot, Book 3") == ["This listing names Book 3 only."] and people.notes("Knot Trilogy") == ["Covers a whole series"]


def test_isbn_scan():
    assert [d for d, _, _ in isbn.scan("978-0-374-37152-4 (pbk.)")] == ["9780374371524"]
    assert [d for d, _, _ in isbn.scan("9780062498533 9780062498540 or 81-7450-835-X")] == ["9780062498533", "9780062498540", "817450835x"]
    assert isbn.scan("see 123456789.") == [("0123456789", 4, 13)] and isbn.scan("12345") == [] and isbn.scan(None) == []


def test_links():
    sheet = "1aBcDeFgHiJkLmNoPqRsTuVwXyZ0123456789"
    assert links.parse_sheet_link(f"docs.google.com/spreadsheets/d/{sheet}/edit#gid=42") == (sheet, "42") and links.parse_sheet_link(sheet) == (sheet, None)
    assert links.parse_sheet_link(f"https://docs.google.com/spreadsheets/d/e/{sheet}/pub") is None and links.parse_sheet_link("https://example.com/x") is None and links.parse_sheet_link(None) is None
    assert links.row_link(sheet, "4", 7, "AB").endswith("gid=4#gid=4&range=A7:AB7") and links.row_link(sheet, "", 7).endswith("/edit") and links.csv_link(sheet, "4").endswith("format=csv&gid=4")
    assert links.https_link("javascript:x") is None and links.cell_link({"userEnteredValue": {"formulaValue": '=HYPERLINK("https://a.b/c","x")'}}) == "https://a.b/c"


def test_rules(spark):
    q = spark.createDataFrame([(1, "Red Widget and more"), (2, "plain")], "query_id int, text string")
    names = spark.createDataFrame([(0, "red widget"), (0, "rw"), (0, "Crimson!")], "group_id int, name string")
    assert {(r.query_id, r.text) for r in rules.alias_queries(q, names).collect()} == {(1, "rw and more"), (1, "crimson and more")}
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8), (2, 1, 9), (2, 2, 3)], "id int, s int, e int")
    assert sorted(map(tuple, rules.merged_spans(spans).collect())) == [(1, 0, 5), (1, 7, 9), (2, 1, 9)]
    found = spark.createDataFrame([(1, 1, 3, 1), (1, 2, 2, 1), (2, 3, 2, 1)], "query_id int, row_id int, tier int, required int")
    assert sorted((r.row_id, r.tier) for r in rules.demoted(found).collect()) == [(1, 3), (2, 1), (3, 2)]


def test_reasons_and_hints(spark):
    rows = spark.createDataFrame([(1, "Sunflower Houses", "grey"), (2, "Parent Teacher News", ""), (3, "ptn yearbook", "")], "id int, title string, author string")
    posted = index.postings(rows, ("title", "author"))
    q = spark.createDataFrame([(1, "gray sun flower hosues"), (2, "parent teacher nights"), (3, "pa"), (4, "ptn yearbook")], "query_id int, text string")
    asked = match.units(q)
    got = {(r.query_id, r.row_id): (r.reasons, r.fields) for r in explain.reasons(asked, posted).collect()}
    assert got[1, 1] == (["similar spelling: houses", "written as: sunflower", "gray = grey"], ["title", "author"])
    assert got[4, 3] == ([], ["title"])
    hints = explain.hints(q, asked, match.search(q, posted, unfinished=False), posted.select("term")).collect()
    assert {(r.query_id, r.code) for r in hints} == {(2, "acronym"), (3, "keepTyping")} and {r.text for r in hints if r.code == "acronym"} == {"ptn"}
