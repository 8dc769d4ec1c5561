"""Rows of equal titles: each title is searched once, and every row that has it is found."""

import duckdb
import pytest

from shelfmark.operators import index, match
from shelfmark.plans import catalogue, judge_queries, rule_queries  # noqa: F401

NAMES = ["red ring", "the red ring", "large bolt", "", None, "red bolt", "old ring red"]
TYPES = ["SMALL", "LARGE tin"]


def made(spark, tmp_path_factory, names):
    folder = str(tmp_path_factory.mktemp("repeats"))
    rows = [(k, names[(k // 100 * 3 + k) % len(names)], f"Brand#{k % 3}", TYPES[k % 2], k % 4) for k in range(1500)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    return made(spark, tmp_path_factory, NAMES)


@pytest.fixture(scope="module")
def two_words(spark, tmp_path_factory):
    return made(spark, tmp_path_factory, ["red ring", "large bolt", "red bolt", "old ring", "cold gear"])


def compared(spark, folder, name):
    got = catalogue.QUERIES[name](spark, folder)
    db = duckdb.connect(config={"threads": 1})  # ties of the SQL's windows come out otherwise by chance
    db.execute(f"CREATE VIEW part AS FROM '{folder}/part.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want) and rows
    assert len(set(rows)) == len(rows)


@pytest.fixture
def listed(monkeypatch):
    """How many rows come to the postings."""
    counts, own = [], index.postings
    monkeypatch.setattr(index, "postings", lambda rows, *a: counts.append(rows.count()) or own(rows, *a))
    return counts


def test_tiered_search(spark, parts, listed):
    compared(spark, parts, "tiered_search")
    assert set(listed) == {len(NAMES)}


def test_possible_half_words(spark, parts, listed):
    compared(spark, parts, "possible_half_words")
    assert set(listed) == {len(NAMES)}


def test_search_exact_all_words(spark, parts, listed):
    compared(spark, parts, "search_exact_all_words")
    assert set(listed) == {len(NAMES)}


def test_full_search(spark, parts, listed):
    got = sorted(map(tuple, catalogue.full_search(spark, parts).collect()))
    assert set(listed) == {len(NAMES)}
    assert got == sorted(map(tuple, match.search(catalogue.asked(spark, parts), catalogue.posted(spark, parts)).collect())) and got


def test_reverse_containment(spark, parts, listed):
    compared(spark, parts, "reverse_containment")
    assert set(listed) == {len(NAMES)}


def test_semi_join_candidates(spark, parts, listed):
    compared(spark, parts, "semi_join_candidates")
    assert set(listed) == {len(NAMES)}


def test_allof_intersection(spark, parts, listed):
    compared(spark, parts, "allof_intersection")
    assert set(listed) == {len(NAMES)}


def test_set_difference(spark, parts, listed):
    compared(spark, parts, "set_difference")
    assert set(listed) == {len(NAMES)}


def test_rank_group_gather(spark, parts, listed):
    compared(spark, parts, "rank_group_gather")
    assert set(listed) == {len(NAMES)}


def test_topk_no_group_split(spark, parts, listed):
    compared(spark, parts, "topk_no_group_split")
    assert set(listed) == {len(NAMES)}


def test_anti_join_siblings(spark, parts, listed):
    compared(spark, parts, "anti_join_siblings")
    assert set(listed) == {len(NAMES)}


def test_group_promotion(spark, parts, listed):
    compared(spark, parts, "group_promotion")
    assert set(listed) == {len(NAMES)}


def test_merge_runs(spark, parts, listed):
    compared(spark, parts, "merge_runs")
    assert set(listed) == {len(NAMES)}


def test_words_in_order(spark, parts, listed):
    compared(spark, parts, "words_in_order")
    assert set(listed) == {len(NAMES)}


def test_adjacent_words(spark, parts, listed):
    compared(spark, parts, "adjacent_words")
    assert set(listed) == {len(NAMES)}


def test_paste_tally(spark, parts, listed):
    compared(spark, parts, "paste_tally")
    assert set(listed) == {len(NAMES)}


def test_union_lookups(spark, parts, listed):
    compared(spark, parts, "union_lookups")
    assert set(listed) == {len(NAMES)}


def judged(spark, two_words, listed, name, *cells):
    """The query's result is SQL's, and each distinct text of the cells came to the postings once."""
    compared(spark, two_words, name)
    rows = judge_queries.listed(spark, two_words)
    assert max(listed) <= max(rows.select(*c).distinct().count() for c in cells) < 1500 / 2


def test_author_words(spark, two_words, listed):
    judged(spark, two_words, listed, "author_words", ["title"], ["author"])


def test_words_beside_authors(spark, two_words, listed):
    judged(spark, two_words, listed, "words_beside_authors", ["author"])


def test_given_names_and_initials(spark, two_words, listed):
    judged(spark, two_words, listed, "given_names_and_initials", ["title", "author"])


def test_author_segments(spark, two_words, listed):
    judged(spark, two_words, listed, "author_segments", ["author"])


def test_scattered_words(spark, two_words, listed):
    judged(spark, two_words, listed, "scattered_words", ["title", "author"])


def test_series_lift(spark, two_words, listed):
    judged(spark, two_words, listed, "series_lift", ["title", "author"])


def test_titles_word_for_word(spark, two_words, listed):
    judged(spark, two_words, listed, "titles_word_for_word", ["title"])


def test_search_highlights(spark, two_words, listed):
    judged(spark, two_words, listed, "search_highlights", ["title"])


def test_marked_titles(spark, two_words, listed):
    judged(spark, two_words, listed, "marked_titles", ["title"])


def test_label_ranges(spark, two_words, monkeypatch):
    counts, own = [], judge_queries.labels.ranges
    monkeypatch.setattr(judge_queries.labels, "ranges", lambda cells, text: counts.append(cells.count()) or own(cells, text))
    compared(spark, two_words, "label_ranges")
    assert max(counts) <= judge_queries.listed(spark, two_words).selectExpr("n2", "id % 4", "id % 40", "id % 90", "id % 60", "id % 9").distinct().count() < 1500


def test_whole_search(spark, two_words, monkeypatch):
    counts, own = [], rule_queries.find.build
    monkeypatch.setattr(rule_queries.find, "build", lambda rows: counts.append(rows.count()) or own(rows))
    found = rule_queries.whole_search(spark, two_words)
    assert counts == [judge_queries.listed(spark, two_words).select("title", "author").distinct().count()] and counts[0] < 750
    assert found.groupBy("query_id", "row_id").count().filter("count > 1").isEmpty()
    assert found.groupBy("query_id").agg({"rank": "max", "*": "count"}).filter("`max(rank)` <> `count(1)`").isEmpty() and not found.isEmpty()
