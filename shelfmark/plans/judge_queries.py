"""Queries on what judges a row beyond its words. The list is made of the parts: their names, and those of the next part, in titles of
several kinds, their types as authors' names. Every part whose key is divisible by 100 asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import folding, native, people
from ..functions.vocabulary import ASKING, FORMAT, LABELS, PUBLISHER, QUESTION, ROLE, SMALL
from ..operators import changes, highlight, index, judge, labels, linediff, match, repeats, screen
from ..operators.staging import kept
from ..sources import readers
from .catalogue import _WORDS, _versions, query, table

_MADE = """SELECT id, n1, n2, m1, m2, t1, t2,
  CASE id % 7 WHEN 0 THEN n1 || ' ' || n2 || ' ' || m1 || ' ' || m2 WHEN 1 THEN 'the ' || n1 || ' ' || n2 || ' and the ' || m2 WHEN 2 THEN 'illustrated ' || n2
    WHEN 3 THEN n1 || ' book ' || n2 WHEN 4 THEN n2 || ' series' WHEN 5 THEN n1 || ' old ' || m1 || ' ' || m2 || ' ' || CAST(id % 9 + 1 AS VARCHAR(9)) ELSE n1 || ' ' || n2 END AS title,
  CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'ann ' || t1 WHEN 2 THEN 'bo ' || t2 || '; ann ' || t1 WHEN 3 THEN 'r l ' || t1 ELSE m1 || ' ' || t1 END AS author
  FROM (SELECT a.p_partkey AS id, split_part(a.p_name, ' ', 1) AS n1, split_part(a.p_name, ' ', 2) AS n2, split_part(coalesce(b.p_name, a.p_name), ' ', 1) AS m1,
    split_part(coalesce(b.p_name, a.p_name), ' ', 2) AS m2, lower(a.p_type) AS t1, lower(coalesce(b.p_type, a.p_type)) AS t2 FROM {part} a LEFT JOIN {part} b ON b.p_partkey = a.p_partkey + 1) p"""
_TEXT = """CASE CAST(floor(id / 100) AS INTEGER) % 10 WHEN 0 THEN title WHEN 1 THEN n1 || ' ' || m2 WHEN 2 THEN 'is illustrated ' || n2 || ' book' WHEN 3 THEN title || ' by ' || m1 || ' zork'
  WHEN 4 THEN 'ann ' || t1 || ' and bo ' || t2 WHEN 5 THEN 'robert lawrence ' || t1 || ' ' || n2 WHEN 6 THEN 'zork blim ' || n1 || ' ' || n2 WHEN 7 THEN n1 || ' book ' || n2
  WHEN 8 THEN n2 || ' say r l ' || t1 ELSE n2 || ' ' || n1 || ' ' || m2 || ' ' || m1 END"""

_list = lambda words: ", ".join(f"'{w}'" for w in words)
_LARGE = f"word NOT IN ({_list(SMALL)})"
_BASE = f"""WITH RECURSIVE l AS ({_MADE.format(part='part')}), q AS (SELECT id AS query_id, {_TEXT} AS text FROM l WHERE id % 100 = 0),
w0 AS (SELECT id AS row_id, 'title' AS field, unnest(range(len(ws))) AS wi, unnest(ws) AS word FROM (SELECT id, {_WORDS.format('title')} AS ws FROM l)
  UNION ALL SELECT id, 'author', unnest(range(len(ws))), unnest(ws) FROM (SELECT id, {_WORDS.format('author')} AS ws FROM l)),
w AS (SELECT *, regexp_full_match(word, '[0-9]+') AS number, CASE WHEN {_LARGE} THEN count(*) FILTER ({_LARGE}) OVER (PARTITION BY row_id, field ORDER BY wi) END AS place FROM w0),
u0 AS (SELECT query_id, unnest(range(len(ws))) AS unit, unnest(ws) AS word FROM (SELECT query_id, {_WORDS.format('text')} AS ws FROM q)),
u1 AS (SELECT *, NOT {_LARGE} AS small, {_LARGE} AND (word IN ({_list([*FORMAT, *QUESTION, *ROLE, *PUBLISHER])}) OR (word IN ({_list(ASKING)}) AND max(word IN ({_list(QUESTION)})) OVER (PARTITION BY query_id))) AS soft FROM u0),
u2 AS (SELECT *, CASE WHEN small THEN 0 WHEN soft THEN 1 ELSE 2 END AS level FROM u1),
u AS (SELECT *, level = max(level) OVER (PARTITION BY query_id) AS required, CASE WHEN NOT small THEN count(*) FILTER (NOT small) OVER (PARTITION BY query_id ORDER BY unit) END AS place,
  regexp_full_match(word, '[b-z]|[b-df-hj-np-tv-xz]{{2,3}}') AND word NOT IN ({_list([*FORMAT, *ROLE, *SMALL])}) AS short FROM u2),
h AS (SELECT query_id, unit, row_id, field, wi FROM u JOIN w USING (word)),
ha AS (SELECT DISTINCT query_id, row_id, unit, u.place FROM h JOIN u USING (query_id, unit) WHERE field = 'author')"""


def listed(spark, sf_dir) -> DataFrame:
    return spark.sql(_MADE, part=table(spark, sf_dir, "part"))


def asked(spark, sf_dir) -> DataFrame:
    return listed(spark, sf_dir).filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.expr(_TEXT).alias("text"))


def _parts(texts: DataFrame, rows: DataFrame, fields: tuple[str, ...] = ("title", "author")) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """units, hits, words and postings of the ASCII form."""
    units = judge.described(texts.select("query_id", F.posexplode(native.words(F.col("text"))).alias("unit", "word")))
    posted = index.postings(rows, fields)
    return units, match.exact_hits(units, posted), judge.cell_words(posted), posted


def _asks(spark, sf_dir) -> repeats.Once:
    """The texts that ask, each once."""
    return repeats.once(asked(spark, sf_dir), "query_id", "text", small=True)


def _surnames(rows: DataFrame) -> DataFrame:
    read = F.pandas_udf(folding._by_distinct(people.surnames), T.ArrayType(T.StringType()))
    return rows.select(F.col("id").alias("row_id"), F.explode(read("author")).alias("surname")).select("row_id", F.lower("surname").alias("surname"))


@query(f"{_BASE} SELECT query_id, CAST(unit AS INTEGER) AS unit, word, required, soft, short, CAST(place AS INTEGER) AS place FROM u")
def required_words(spark, sf_dir):
    """Q1 to Q3."""
    return _parts(asked(spark, sf_dir), listed(spark, sf_dir))[0].select("query_id", "unit", "word", "required", "soft", "short", "place")


@query(f"""{_BASE}, t AS (SELECT DISTINCT a.word AS first, b.word AS second FROM w a JOIN w b ON a.row_id = b.row_id AND a.field = 'title' AND b.field = 'title' AND b.place = a.place + 1),
one AS (SELECT query_id, max(place) AS place FROM u WHERE required GROUP BY query_id HAVING count(*) = 1),
need(query_id, place) AS (SELECT query_id, place FROM one UNION SELECT n.query_id, a.place FROM need n JOIN u b ON b.query_id = n.query_id AND b.place = n.place
  JOIN u a ON a.query_id = n.query_id AND a.place = n.place - 1 JOIN t ON t.first = a.word AND t.second = b.word WHERE NOT a.required AND a.word IN ({_list([*FORMAT, *QUESTION, *ASKING])}) AND a.soft)
SELECT u.query_id, CAST(u.unit AS INTEGER) AS unit FROM need JOIN u USING (query_id, place) WHERE NOT u.required""")
def phrased_words(spark, sf_dir):
    """A11."""
    units, _, words, posted = _parts(asked(spark, sf_dir), listed(spark, sf_dir))
    forms = units.select("query_id", "unit", F.col("word").alias("term"))
    return judge.phrased(units, forms, judge.title_pairs(posted, words))


@query(f"""{_BASE}, f AS (SELECT u.query_id, u.unit, bool_or(h.field = 'author') AS author, bool_or(h.field IS NOT NULL) AS known FROM u LEFT JOIN h USING (query_id, unit) WHERE u.required GROUP BY 1, 2),
b AS (SELECT a.query_id, a.unit FROM u a JOIN u x ON x.query_id = a.query_id AND x.word = 'by' AND x.unit < a.unit WHERE NOT a.small
  AND NOT EXISTS (SELECT 1 FROM u y WHERE y.query_id = a.query_id AND y.unit > x.unit AND y.unit < a.unit AND y.small)),
k AS (SELECT u.query_id, u.unit, coalesce(f.author, false) OR EXISTS (SELECT 1 FROM b WHERE b.query_id = u.query_id AND b.unit = u.unit) AS author_word, coalesce(f.known, false) AS known, u.word, u.short,
  row_number() OVER (PARTITION BY u.query_id ORDER BY u.unit) AS i, count(*) OVER (PARTITION BY u.query_id) AS n FROM u LEFT JOIN f ON f.query_id = u.query_id AND f.unit = u.unit WHERE u.required),
g AS (SELECT *, NOT author_word AND NOT known AND NOT short AND regexp_full_match(word, '[a-z]+') AS unknown FROM k),
e AS (SELECT query_id, coalesce(min(i) FILTER (NOT unknown) - 1, max(n)) AS head, coalesce(max(n) - max(i) FILTER (NOT unknown), max(n)) AS tail FROM g GROUP BY query_id)
SELECT query_id, CAST(unit AS INTEGER) AS unit, author_word, (head BETWEEN 2 AND 3 AND head < n AND i <= head) OR (tail BETWEEN 2 AND 3 AND tail < n AND i > n - tail) AS name_guess FROM g JOIN e USING (query_id)""")
def author_words(spark, sf_dir):
    """A10."""
    asks, rows = _asks(spark, sf_dir), listed(spark, sf_dir)
    units, hits, _, _ = _parts(asks.one, repeats.once(rows, "id", "title").one, ("title",))
    _, by, _, _ = _parts(asks.one, repeats.once(rows, "id", "author").one, ("author",))  # no fact needs a title and its author at once
    return repeats.spread(judge.author_facts(units, hits.unionByName(by)), asks)


@query(f"{_BASE} SELECT DISTINCT ha.query_id, ha.row_id, CAST(u.unit AS INTEGER) AS unit FROM ha JOIN u ON u.query_id = ha.query_id AND abs(u.place - ha.place) = 1")
def words_beside_authors(spark, sf_dir):
    """J14."""
    asks, lists = _asks(spark, sf_dir), repeats.once(listed(spark, sf_dir), "id", "author")
    units, hits, _, _ = _parts(asks.one, lists.one, ("author",))
    return repeats.spread(judge.beside_author(units, hits), asks, lists)


@query(f"""{_BASE}, near AS (SELECT DISTINCT ha.query_id, ha.row_id, u.unit FROM ha JOIN u ON u.query_id = ha.query_id AND abs(u.place - ha.place) = 1),
m AS (SELECT p.query_id, p.row_id, u.unit, u.word, u.short, u.place FROM (SELECT DISTINCT query_id, row_id FROM near) p JOIN u ON u.query_id = p.query_id AND u.required
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = p.query_id AND h.row_id = p.row_id AND h.unit = u.unit)),
used AS (SELECT query_id, row_id, count(DISTINCT wi) AS used FROM h WHERE field = 'author' GROUP BY 1, 2), cells AS (SELECT row_id, count(*) AS n FROM w WHERE field = 'author' AND place IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT unnest(list_transform(string_split(author, ';'), lambda x: string_split(trim(x), ' ')[-1])) AS word FROM l WHERE author <> ''),
i AS (SELECT id AS row_id FROM l WHERE author LIKE 'r l %'),
run AS (SELECT m.query_id, m.row_id, string_agg(substr(word, 1, 1), '' ORDER BY place) AS typed, max(place) - min(place) + 1 = count(*) AS whole, bool_or(near.unit IS NOT NULL) AS beside FROM m LEFT JOIN near ON near.query_id = m.query_id AND near.row_id = m.row_id AND near.unit = m.unit
  WHERE NOT short AND regexp_full_match(word, '[a-z]+') GROUP BY 1, 2)
SELECT m.query_id, m.row_id, CAST(m.unit AS INTEGER) AS unit, false AS spelt FROM m JOIN near USING (query_id, row_id, unit) JOIN used USING (query_id, row_id) JOIN cells USING (row_id) WHERE short AND n > used AND word NOT IN (SELECT word FROM s)
UNION ALL SELECT m.query_id, m.row_id, CAST(m.unit AS INTEGER), true FROM m JOIN run USING (query_id, row_id) JOIN i USING (row_id) WHERE NOT short AND regexp_full_match(word, '[a-z]+') AND whole AND beside AND typed = 'rl'""")
def given_names_and_initials(spark, sf_dir):
    """A7."""
    asks, lists = _asks(spark, sf_dir), repeats.once(listed(spark, sf_dir), "id", "title", "author")
    units, hits, words, _ = _parts(asks.one, lists.one)
    authors = lists.one.select(F.col("id").alias("row_id"), judge.initials(F.col("author")).alias("initials"))
    return repeats.spread(judge.excused(units, hits, authors, words, _surnames(lists.one)), asks, lists)


@query(f"""{_BASE}, g AS (SELECT query_id, list_filter(list_transform(string_split(text, ' and '), lambda s: list_filter(regexp_extract_all(s, '[a-z0-9]+'), lambda x: x NOT IN ({_list([*SMALL, *FORMAT, *QUESTION, *ROLE, *PUBLISHER])}))), lambda s: len(s) > 0) AS segs FROM q),
s AS (SELECT query_id, len(segs) AS segments, unnest(range(len(segs))) AS segment, unnest(segs) AS ws FROM g WHERE len(segs) >= 2 AND len(list_filter(segs, lambda x: len(x) > 4)) = 0),
c AS (SELECT DISTINCT query_id, segments, segment, unnest(list_filter(ws, lambda x: NOT regexp_full_match(x, '[b-z]|[b-df-hj-np-tv-xz]{{2,3}}'))) AS word FROM s),
n AS (SELECT query_id, segment, count(*) AS size FROM c GROUP BY 1, 2),
f AS (SELECT query_id, row_id, segment, segments, count(DISTINCT word) AS hit FROM c JOIN w USING (word) WHERE field = 'author' GROUP BY 1, 2, 3, 4)
SELECT query_id, row_id, count(*) AS held, segments FROM f JOIN n USING (query_id, segment) WHERE hit = size GROUP BY query_id, row_id, segments""")
def author_segments(spark, sf_dir):
    """A8."""
    asks, lists = _asks(spark, sf_dir), repeats.once(listed(spark, sf_dir), "id", "author")
    return repeats.spread(judge.segment_hits(judge.segments(asks.one), index.postings(lists.one, ("author",))), asks, lists)


_FILLER = _list([*FORMAT, *ROLE, *LABELS])


@query(f"""{_BASE}, big AS (SELECT row_id, wi FROM w WHERE field = 'title' AND place IS NOT NULL AND NOT number AND word NOT IN ({_list([*FORMAT, *LABELS])})),
size AS (SELECT row_id, count(*) AS size FROM big GROUP BY 1), held AS (SELECT query_id, row_id, count(DISTINCT wi) AS held FROM h JOIN big USING (row_id, wi) WHERE field = 'title' GROUP BY 1, 2),
own AS (SELECT DISTINCT h.query_id, h.row_id, h.unit, wi FROM h JOIN u USING (query_id, unit) WHERE field = 'title' AND required AND NOT regexp_full_match(word, '[0-9]+')
  AND NOT EXISTS (SELECT 1 FROM ha WHERE ha.query_id = h.query_id AND ha.row_id = h.row_id AND ha.unit = h.unit)),
sets AS (SELECT query_id, row_id, count(DISTINCT unit) AS sets FROM own GROUP BY 1, 2 HAVING count(DISTINCT unit) >= 2),
d AS (SELECT s.* FROM sets s LEFT JOIN held USING (query_id, row_id) LEFT JOIN size USING (row_id) WHERE coalesce(held, 0) * 2 <= coalesce(size, 0)),
step(query_id, row_id, start, wi) AS (SELECT query_id, row_id, wi, wi FROM (SELECT DISTINCT query_id, row_id, wi FROM own) JOIN d USING (query_id, row_id)
  UNION SELECT s.query_id, s.row_id, s.start, w.wi FROM step s JOIN w ON w.row_id = s.row_id AND w.field = 'title' AND w.wi = s.wi + 1
  WHERE w.place IS NULL OR w.number OR w.word IN ({_FILLER}) OR EXISTS (SELECT 1 FROM own o WHERE o.query_id = s.query_id AND o.row_id = s.row_id AND o.wi = w.wi)),
best AS (SELECT query_id, row_id, max(n) AS n FROM (SELECT s.query_id, s.row_id, s.start, count(DISTINCT o.unit) AS n FROM step s JOIN own o ON o.query_id = s.query_id AND o.row_id = s.row_id AND o.wi = s.wi GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT query_id, row_id FROM d JOIN best USING (query_id, row_id) WHERE n < sets""")
def scattered_words(spark, sf_dir):
    """A5."""
    asks, lists = _asks(spark, sf_dir), repeats.once(listed(spark, sf_dir), "id", "title", "author")
    own = kept(lists.one, "pairs")
    titles, authors = repeats.once(own, "id", "title"), repeats.once(own, "id", "author")
    cells = [x.every.select(F.col("id").alias("row_id"), F.col("first").alias(name)) for x, name in ((titles, "by_title"), (authors, "by_author"))]
    pairs = kept(cells[0].join(cells[1], "row_id"), "cells")
    units, hits, words, _ = _parts(asks.one, titles.one, ("title",))
    units, hits = kept(units, "units"), kept(hits, "hits")
    by = kept(match.exact_hits(units, index.postings(authors.one, ("author",))), "by")
    # a title is judged once for each text; again beside each author that has a required word of the text, if two such words are in the title
    required = units.filter("required").select("query_id", "unit")
    beside = kept(by.join(required, ["query_id", "unit"], "left_semi").select("query_id", F.col("row_id").alias("by_author")).distinct(), "beside")
    two = hits.join(required, ["query_id", "unit"], "left_semi").groupBy("query_id", F.col("row_id").alias("by_title")).agg(F.count_distinct("unit").alias("n")).filter("n >= 2").drop("n")
    apart = judge.scattered(units, hits, words).withColumnRenamed("row_id", "by_title").join(pairs, "by_title").join(beside, ["query_id", "by_author"], "left_anti")
    near = kept(pairs.join(beside, "by_author").join(two, ["query_id", "by_title"], "left_semi"), "near")
    both = [near.join(h.withColumnRenamed("row_id", name), ["query_id", name]).select(*hits.columns) for h, name in ((hits, "by_title"), (by, "by_author"))]
    named = judge.scattered(units, both[0].unionByName(both[1]), judge.cell_words(index.postings(own, ("title",))))
    return repeats.spread(apart.select("query_id", "row_id").unionByName(named), asks, lists)


@query(f"""{_BASE}, s AS (SELECT id AS row_id, n2 AS name, CASE WHEN author = '' THEN [] ELSE list_transform(string_split(author, ';'), lambda x: string_split(trim(x), ' ')[-1]) END AS surnames FROM l WHERE id % 7 = 4),
x AS (SELECT query_id, row_id, bool_or(h.field = 'title' AND w.word = name) AS named, bool_or(h.field = 'author') AS author, bool_or(h.field = 'author' AND list_contains(surnames, w.word)) AS surname
  FROM h JOIN s USING (row_id) JOIN w USING (row_id, field, wi) GROUP BY 1, 2)
SELECT query_id, row_id, (named AND author) OR surname AS pinned FROM x WHERE named OR surname""")
def series_lift(spark, sf_dir):
    """A6, B6."""
    covers = F.pandas_udf(folding._by_distinct(people.covers_series), T.BooleanType())
    asks, lists = _asks(spark, sf_dir), repeats.once(listed(spark, sf_dir), "id", "title", "author")
    names = kept(judge.series_names(lists.one.select(F.col("id").alias("row_id"), "title"), covers("title")), "names")
    rows = kept(lists.one.join(names.select(F.col("row_id").alias("id")), "id", "left_semi"), "series")  # no other row's hits count
    _, hits, words, _ = _parts(asks.one, rows)
    return repeats.spread(judge.series_lifts(hits, names, _surnames(rows), words), asks, lists)


@query(f"""{_BASE}, items AS (SELECT row_id, wi, row_number() OVER (PARTITION BY row_id ORDER BY wi) - 1 AS item, count(*) OVER (PARTITION BY row_id) AS size FROM w WHERE field = 'title' AND place IS NOT NULL AND word NOT IN ({_list(FORMAT)})),
need AS (SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY unit) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM u WHERE required),
e AS (SELECT DISTINCT h.query_id, h.row_id, k, n, item FROM h JOIN need USING (query_id, unit) JOIN items USING (row_id, wi) WHERE field = 'title' AND n = size),
m(query_id, row_id, k, n, taken) AS (SELECT query_id, row_id, k, n, 1 << item FROM e WHERE k = 1 UNION SELECT e.query_id, e.row_id, e.k, e.n, m.taken | (1 << e.item) FROM m JOIN e ON e.query_id = m.query_id AND e.row_id = m.row_id AND e.k = m.k + 1 WHERE m.taken & (1 << e.item) = 0)
SELECT DISTINCT query_id, row_id FROM m WHERE k = n""")
def titles_word_for_word(spark, sf_dir):
    """J16."""
    asks, lists = _asks(spark, sf_dir), repeats.once(listed(spark, sf_dir), "id", "title")
    units, hits, words, _ = _parts(asks.one, lists.one, ("title",))
    return repeats.spread(judge.title_equals(units, hits, words), asks, lists)


_MARKS = f"""{_BASE}, r AS (SELECT row_id, wi, word, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY row_id ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM w WHERE field = 'title'),
f AS (SELECT u.query_id, u.unit, u.word AS typed, u.small, unit = max(unit) OVER (PARTITION BY query_id) AS last FROM u),
x AS (SELECT query_id, row_id, wi, small, s, s + length(typed) AS e FROM f JOIN r ON r.word = typed OR (last AND length(typed) >= 3 AND starts_with(r.word, typed))),
y AS (SELECT * FROM x WHERE NOT small UNION ALL SELECT a.* FROM x a WHERE small AND EXISTS (SELECT 1 FROM x b WHERE NOT b.small AND b.query_id = a.query_id AND b.row_id = a.row_id AND abs(b.wi - a.wi) = 1)),
z AS (SELECT *, max(e) OVER (PARTITION BY query_id, row_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM y),
i AS (SELECT *, sum(CASE WHEN s > before OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, row_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM z),
m AS (SELECT query_id, row_id, min(s) AS s, max(e) AS e FROM i GROUP BY query_id, row_id, island)"""


def _highlights(asks: repeats.Once, lists: repeats.Once) -> DataFrame:
    units, hits, _, posted = _parts(asks.one, lists.one, ("title",))
    hits = hits.unionByName(match.prefix_hits(units, posted))
    return highlight.highlights(units, hits, highlight.word_ranges(lists.one.select(F.col("id").alias("row_id"), "title"), ("title",)))


@query(f"{_MARKS} SELECT query_id, row_id, 'title' AS field, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM m")
def search_highlights(spark, sf_dir):
    """O2: the ranges of titles that the queries' words have, the last word as far as it was typed."""
    asks, lists = _asks(spark, sf_dir), repeats.once(listed(spark, sf_dir), "id", "title")
    return repeats.spread(_highlights(asks, lists), asks, lists)


@query(f"""{_MARKS}, n AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY query_id, row_id ORDER BY s), 0) AS before FROM m)
    SELECT query_id, row_id, string_agg(substr(title, CAST(before AS INTEGER) + 1, CAST(s - before AS INTEGER)) || '[' || substr(title, CAST(s AS INTEGER) + 1, CAST(e - s AS INTEGER)) || ']', '' ORDER BY s) || substr(any_value(title), CAST(max(e) AS INTEGER) + 1) AS shown
    FROM n JOIN l ON l.id = row_id GROUP BY query_id, row_id""")
def marked_titles(spark, sf_dir):
    """O3: titles with their ranges in brackets; the ranges come out of order, and one that lies beyond the end among them."""
    asks, lists = _asks(spark, sf_dir), repeats.once(listed(spark, sf_dir), "id", "title")
    spans = _highlights(asks, lists).groupBy("query_id", "row_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    shown = spans.join(lists.one.select(F.col("id").alias("row_id"), "title"), "row_id")
    parts = highlight.marked(F.col("title"), F.concat(F.reverse("spans"), F.array(F.struct(F.lit(900).alias("s"), F.lit(999).alias("e")))))
    text = F.array_join(F.transform(parts, lambda x: F.when(x["mark"], F.concat(F.lit("["), x["text"], F.lit("]"))).otherwise(x["text"])), "")
    return repeats.spread(shown.select("query_id", "row_id", text.alias("shown")), asks, lists)


@query("""WITH RECURSIVE v AS (SELECT event_type AS tab, CAST(user_id AS VARCHAR) AS fingerprint, list(event_id ORDER BY event_id) FILTER (event_id % 2 = 0) AS olds, list(event_id ORDER BY event_id) FILTER (event_id % 2 = 1) AS news FROM events GROUP BY 1, 2),
n AS (SELECT tab, fingerprint, coalesce(olds, []) AS olds, coalesce(news, []) AS news FROM v),
g(tab, fingerprint, k, olds, free, took) AS (SELECT tab, fingerprint, 0, olds, news, CAST(NULL AS BIGINT) FROM n WHERE len(olds) <> len(news) AND len(olds) > 0 AND len(news) > 0
  UNION ALL SELECT tab, fingerprint, k + 1, olds, list_filter(free, lambda x: x IS DISTINCT FROM best), best
  FROM (SELECT *, list_sort(list_transform(free, lambda x: {'d': abs(x - olds[k + 1]), 'x': x}))[1].x AS best FROM g WHERE k < len(olds))),
r AS (SELECT tab, fingerprint, olds[k] AS old_row, took AS new_row FROM g WHERE k > 0 UNION ALL SELECT tab, fingerprint, NULL, unnest(free) FROM g WHERE k = len(olds)
  UNION ALL SELECT tab, fingerprint, unnest(olds), unnest(news) FROM n WHERE len(olds) = len(news) OR len(olds) = 0 OR len(news) = 0)
SELECT tab, fingerprint, coalesce(old_row, -1) AS old_row, coalesce(new_row, -1) AS new_row FROM r""")
def snapshot_pairs_nearest(spark, sf_dir):
    """J15, R4."""
    return changes.paired_nearest(*_versions(spark, sf_dir)).fillna(-1, ["old_row", "new_row"])


@query()
def list_line_diff(spark, sf_dir):
    """U5s, G4: each document's lines against another version of it, in which some are left out, some are put otherwise, and the first comes last."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tab"), "text")
    lines = linediff.lines_of(F.col("text"))
    other = F.filter(F.transform(lines, lambda x, i: F.when(i % 7 == 3, None).when(i % 5 == 2, F.upper(x)).otherwise(x)), lambda x: x.isNotNull())
    return linediff.hunks(linediff.line_diff(docs, docs.select("tab", F.array_join(F.concat(F.slice(other, 2, 1 << 30), F.slice(other, 1, 1)), "\n").alias("text"))))


_VOLUMES = "n2 || CASE id % 4 WHEN 0 THEN ' Books ' || CAST(id % 40 + 1 AS VARCHAR(9)) || '-' || CAST(id % 40 + 1 + id % 90 AS VARCHAR(9)) WHEN 1 THEN ', Vol. ' || CAST(id % 60 + 1 AS VARCHAR(9)) WHEN 2 THEN ' grade ' || CAST(id % 9 + 1 AS VARCHAR(9)) || ' to ' || CAST(id % 9 + 2 AS VARCHAR(9)) ELSE '' END"


@query(f"""WITH l AS ({_MADE.format(part='part')}), r AS (SELECT id AS row_id, n2, CASE id % 4 WHEN 2 THEN 'grade' ELSE 'book' END AS label, CASE id % 4 WHEN 0 THEN id % 40 + 1 WHEN 1 THEN id % 60 + 1 ELSE id % 9 + 1 END AS low,
  CASE id % 4 WHEN 0 THEN id % 40 + 1 + id % 90 WHEN 1 THEN id % 60 + 1 ELSE id % 9 + 2 END AS high FROM l WHERE id % 4 < 3),
q AS (SELECT id AS query_id, n2, CASE floor(id / 100) % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'book' ELSE 'grade' END AS label, CAST(floor(id / 100) AS INTEGER) * 7 % 90 + 1 AS n FROM l WHERE id % 100 = 0),
e AS (SELECT DISTINCT query_id, row_id, q.label FROM q JOIN r ON q.label = r.label AND n BETWEEN low AND high)
SELECT query_id, row_id, label, 'exact' AS kind FROM e UNION ALL SELECT DISTINCT query_id, r.row_id, q.label, 'loose' FROM q JOIN r ON q.n2 = r.n2 AND q.label = r.label WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = q.query_id AND e.row_id = r.row_id)""")
def label_ranges(spark, sf_dir):
    """A number that is asked meets ranges of any length; rows that share the query's noun and label, but no number, are loose."""
    own = listed(spark, sf_dir).select("id", "n2", F.expr(_VOLUMES).alias("title"))
    k = F.floor(F.col("id") / 100).cast("int")
    text = F.concat(F.when(k % 3 == 0, "book ").when(k % 3 == 1, "volume no. ").otherwise("Grade #"), (k * 7 % 90 + 1).cast("string"))
    some = own.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "n2", text.alias("text"))
    asks, lists = repeats.once(some, "query_id", "n2", "text", small=True), repeats.once(own, "id", "n2", "title")
    typed = labels.ranges(asks.one.select("query_id", "text"), "text")
    rows = labels.ranges(lists.one.select(F.col("id").alias("row_id"), "title"), "title")
    shared = asks.one.select("query_id", "n2").join(lists.one.select(F.col("id").alias("row_id"), "n2"), "n2")
    return repeats.spread(labels.label_hits(typed, rows, shared), asks, lists)


@query("""SELECT n_nationkey AS gid, n_name AS tab, CASE n_nationkey % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'empty' WHEN 3 THEN 'html' END AS kind,
    CASE WHEN n_nationkey % 5 IN (0, 4) THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1 ELSE 0 END AS records FROM nation""")
def tabs_with_errors(spark, sf_dir):
    """A tab of each nation's suppliers; of every five tabs one is missing, one empty and one a web page, and the others load."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    lines = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.collect_list("s_name"), "\n").alias("lines"))
    k = F.col("n_nationkey") % 5
    content = F.when(k == 2, "  \n").when(k == 3, "<!DOCTYPE html><p>Sign in").otherwise(F.concat_ws("\n", F.lit("Title"), "lines"))
    path = F.concat(F.lit("lists/"), F.col("n_nationkey").cast("string"), F.lit(".csv"))
    files = nation.join(lines, "n_nationkey", "left").filter(k != 1).select(F.concat(F.lit("file:/data/"), path).alias("path"), content.alias("content"))
    wanted = nation.select(F.col("n_name").alias("tab"), F.col("n_nationkey").cast("string").alias("gid"), path.alias("path"))
    records, errors = readers.load_tabs(wanted, files)
    found = records.groupBy("tab").agg(F.count(F.lit(1)).alias("records"))
    own = nation.select(F.col("n_nationkey").alias("gid"), F.col("n_name").alias("tab"))
    return own.join(errors.select("tab", "kind"), "tab", "left").join(found, "tab", "left").select("gid", "tab", "kind", F.coalesce("records", F.lit(0)).alias("records"))


_ITEM = """SELECT o_orderkey AS item_id, o_orderpriority AS tab, CASE o_orderkey % 4 WHEN 0 THEN title WHEN 1 THEN substr(title, 1, 1) || substr(title, 3) WHEN 2 THEN n2 || ' say cheese' ELSE title || ' zork' END AS title,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN author ELSE 'zork blim' END AS author FROM {orders} JOIN ({made}) m ON m.id = o_orderkey % 200"""
_KEYED = "regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '')"
_FOUND = f"""WITH l AS ({_MADE.format(part='part')}), i AS (SELECT item_id, tab, title, author, {_KEYED.format('title')} AS key, regexp_replace(author, '[^a-z0-9]', '', 'g') AS ia FROM ({_ITEM.format(orders='orders', made=_MADE.format(part='part'))})),
r AS (SELECT id AS row_id, title AS listed, author AS listed_author, id % 7 = 4 AS series, n2, {_KEYED.format('title')} AS rk, regexp_replace(author, '[^a-z0-9]', '', 'g') AS ra FROM l),
k AS (SELECT DISTINCT key, ia FROM i), kk AS (SELECT DISTINCT key, string_split(key, ' ') AS ws FROM k), rr AS (SELECT DISTINCT rk, string_split(rk, ' ') AS rs FROM r),
d AS (SELECT key, rk, list_filter(list_zip(ws, rs), lambda x: x[1] <> x[2]) AS diff FROM kk JOIN rr ON len(ws) = len(rs) AND key <> rk),
n AS (SELECT key, rk FROM (SELECT key, rk, diff[1][1] AS a, diff[1][2] AS b FROM d WHERE len(diff) = 1) WHERE least(length(a), length(b)) >= 4 AND (substr(a, 1, 1) = substr(b, 1, 1) OR substr(a, 2, 1) = substr(b, 2, 1))
  AND damerau_levenshtein(a, b) <= CASE WHEN least(length(a), length(b)) <= 7 THEN 1 ELSE 2 END AND abs(length(a) - length(b)) <= CASE WHEN least(length(a), length(b)) <= 7 THEN 1 ELSE 2 END),
ins AS (SELECT key, rk FROM kk JOIN rr ON key <> rk AND len(list_distinct(rs)) >= 2 AND list_has_all(ws, rs)),
h AS (SELECT key, ia, row_id, CASE WHEN ia = '' OR ra = '' THEN 4 WHEN ia = ra THEN 5 ELSE 2 END AS reason FROM k JOIN r ON key = rk
  UNION ALL SELECT k.key, ia, row_id, 1 FROM k JOIN n USING (key) JOIN r USING (rk) WHERE ia = '' OR ra = '' OR ia = ra
  UNION ALL SELECT k.key, ia, row_id, 0 FROM k JOIN ins USING (key) JOIN r USING (rk)
  UNION ALL SELECT k.key, ia, row_id, 3 FROM k JOIN kk USING (key) JOIN r ON series AND list_contains(ws, n2)),
b AS (SELECT key, ia, row_id, max(reason) AS reason FROM h GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY key, ia ORDER BY reason DESC, row_id) AS place, count(*) OVER (PARTITION BY key, ia) AS total FROM b),
f AS (SELECT item_id, tab, title, author, p.* FROM i JOIN p USING (key, ia) WHERE place <= 5)"""


def _findings(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = listed(spark, sf_dir).select(F.col("id").alias("row_id"), "title", "author")
    items = spark.sql(_ITEM.format(orders="{orders}", made=_MADE), orders=table(spark, sf_dir, "orders"), part=table(spark, sf_dir, "part"))
    covers = F.pandas_udf(folding._by_distinct(people.covers_series), T.BooleanType())
    return screen.findings(items, rows, judge.series_names(rows.select("row_id", "title"), covers("title"))), items, rows


@query(f"{_FOUND} SELECT item_id, tab, CAST(place AS INTEGER) AS place, row_id, CAST(reason AS INTEGER) AS reason, CASE WHEN reason >= 3 THEN 'likely' ELSE 'look' END AS strength, CAST(greatest(total - 5, 0) AS BIGINT) AS more FROM f")
def screening_findings(spark, sf_dir):
    """Titles as listed, misspelt, of a series, and with a listed title within; each with its five best rows."""
    return _findings(spark, sf_dir)[0]


_WHY = "CASE reason " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in screen.REASONS.items()) + " END"


@query(f"""{_FOUND}, g AS (SELECT item_id, CAST(place AS INTEGER) AS place, tab, title, author, CASE WHEN reason >= 3 THEN 'Likely banned' ELSE 'Worth a look' END AS result, r.listed, r.listed_author, {_WHY} AS why, total FROM f JOIN r USING (row_id))
    SELECT item_id, place, tab, title, author, result, listed, listed_author, why FROM g UNION ALL SELECT item_id, 1073741824, tab, title, author, result, '…and ' || (total - 5) || ' more', '', '' FROM g WHERE place = 1 AND total > 5""")
def screening_grid(spark, sf_dir):
    """O5."""
    return screen.result_grid(*_findings(spark, sf_dir))
