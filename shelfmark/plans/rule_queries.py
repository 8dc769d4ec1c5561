"""Queries on the search's rules; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folding, isbn, native
from ..operators import find, index, match, quality, repeats, rules
from ..operators.staging import kept
from .catalogue import ASKED, _ISBNS, _POSTED, _TIERS, _UNITS, _WORDS, _isbns, distinct, query, rows, table

_GROUPS = f"k AS (SELECT p_partkey AS row_id, array_to_string(list_sort({_WORDS.format('p_name')}), ' ') AS group_key FROM part)"
_TIERED = f"{_TIERS}, t AS (SELECT query_id, row_id, CASE WHEN strong = required THEN 3 ELSE 1 END AS tier, required FROM found WHERE strong * 2 >= required)"


@query(f"""{_TIERED}, {_GROUPS} SELECT query_id, row_id, CASE WHEN tier = 1 AND max(tier >= 2) OVER (PARTITION BY query_id, group_key) THEN 2 ELSE tier END AS tier FROM t JOIN k USING (row_id)""")
def group_promotion(spark, sf_dir):
    own = distinct(spark, sf_dir)
    keys = own.lists.one.select(F.col("id").alias("row_id"), index.author_key(F.col("title")).alias("group_key"))
    return own.spread(rules.promoted(own.tiered().join(keys, "row_id")).select("query_id", "row_id", "tier"))


@query(f"""{_TIERED}, r AS (SELECT query_id, 0 AS run, row_id, tier FROM t UNION ALL SELECT DISTINCT query_id, 1, row_id, 2 FROM hits WHERE unit = 1)
    SELECT query_id, row_id, tier, run FROM (SELECT *, row_number() OVER (PARTITION BY query_id, row_id ORDER BY tier DESC, run) AS n FROM r) WHERE n = 1""")
def merge_runs(spark, sf_dir):
    """A query's run, and one that finds what its second word hits."""
    own = distinct(spark, sf_dir)
    base = own.tiered().select("query_id", F.lit(0).alias("run"), "row_id", "tier")
    second = match.exact_hits(own.units.filter("unit = 1 AND required"), own.posted).select("query_id", F.lit(1).alias("run"), "row_id", F.lit(2).alias("tier")).distinct()
    return own.spread(rules.merged_runs(base.unionByName(second)).select("query_id", "row_id", "tier", "run"))


@query(f"""WITH {_UNITS}, {_POSTED}, h AS (SELECT query_id, row_id, unit, min(wi) AS wi FROM units JOIN posted ON word = term GROUP BY 1, 2, 3),
    s AS (SELECT *, wi - lag(wi) OVER (PARTITION BY query_id, row_id ORDER BY unit) AS step FROM h)
    SELECT query_id, row_id, CAST(coalesce(min(CASE WHEN step = 1 THEN 2 WHEN step > 1 THEN 1 WHEN step IS NOT NULL THEN 0 END), 1) AS INTEGER) AS in_order FROM s GROUP BY 1, 2""")
def words_in_order(spark, sf_dir):
    own = distinct(spark, sf_dir)
    return own.spread(rules.in_order(match.best_hits(own.hits).select("query_id", "row_id", "unit", "wi")))


_PAIRS = "(SELECT p_partkey, split_part(p_name, ' ', 1 + CAST(floor(p_partkey / 100) AS INTEGER) % 2), split_part(p_name, ' ', 2 - CAST(floor(p_partkey / 100) AS INTEGER) % 2) FROM {part} WHERE p_partkey % 100 = 0)"


@query(f"WITH {_POSTED} SELECT DISTINCT pair_id, a.row_id FROM {_PAIRS.format(part='part')} AS p(pair_id, first, second) JOIN posted a ON a.term = first JOIN posted b ON b.row_id = a.row_id AND b.wi = a.wi + 1 AND b.term = second")
def adjacent_words(spark, sf_dir):
    pairs = spark.sql(f"SELECT pair_id, first, second FROM {_PAIRS} AS p(pair_id, first, second)", part=table(spark, sf_dir, "part"))
    asks, lists = repeats.once(pairs, "pair_id", "first", "second", small=True), repeats.once(rows(spark, sf_dir), "id", "title")
    found = rules.adjacent(index.postings(lists.one), asks.one).withColumnRenamed("pair_id", "query_id")
    return repeats.spread(found, asks, lists).withColumnRenamed("query_id", "pair_id")


@query(f"""WITH b AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark), d AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS term FROM documents),
    s AS (SELECT item_id, ws, unnest(range(1, len(ws))) AS s FROM b), n AS (SELECT item_id, ws, s, unnest(range(2, CAST(least(6, len(ws) - s + 1) AS BIGINT) + 1)) AS n FROM s),
    i AS (SELECT DISTINCT item_id AS query_id, array_to_string(list_transform(ws[s:s + n - 1], lambda w: substr(w, 1, 1)), '') AS term FROM n)
    SELECT query_id, term FROM i WHERE term IN (SELECT term FROM d)""")
def acronym_terms(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rules.acronyms(queries, table(spark, sf_dir, "documents").select(F.explode(native.words(F.col("text"))).alias("term"))).select("query_id", "term")


@query(f"""{_TIERED}, q AS (SELECT DISTINCT query_id FROM {{0}}), b AS (SELECT query_id, max(tier) AS tier FROM t GROUP BY 1)
    SELECT CASE tier WHEN 3 THEN 'listed' WHEN 2 THEN 'close' WHEN 1 THEN 'possible' ELSE 'none' END AS outcome, count(*) AS lines FROM q LEFT JOIN b USING (query_id) GROUP BY 1""".format(ASKED))
def paste_tally(spark, sf_dir):
    own = distinct(spark, sf_dir)
    best = own.tiered().groupBy("query_id").agg(F.max("tier").alias("tier"))
    return rules.tally(own.asks.every, repeats.spread(best, own.asks))


@query("""WITH e AS (SELECT l_orderkey AS id, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS e FROM lineitem),
    m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM e WHERE e > s),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT id, CAST(min(s) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e FROM i GROUP BY id, island""")
def highlight_merge(spark, sf_dir):
    n = F.col("l_linenumber") * 10
    return rules.merged_spans(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("s"), (n + F.col("l_quantity").cast("int")).alias("e")))


_ALIASES = "(VALUES (0, 'Red Widget'), (0, 'crimson gadget'), (0, 'rw'), (1, 'cold'), (1, 'chilly'))"


@query(f"""WITH q AS (SELECT p_partkey AS query_id, array_to_string({_WORDS.format('p_name')}, ' ') AS plain FROM part),
    a AS (SELECT g, lower(name) AS key FROM {_ALIASES} AS a(g, name)),
    m AS (SELECT DISTINCT query_id, trim(replace(' ' || plain || ' ', ' ' || a.key || ' ', ' ' || o.key || ' ')) AS text FROM q JOIN a ON contains(' ' || plain || ' ', ' ' || a.key || ' ') JOIN a o ON o.g = a.g AND o.key <> a.key)
    SELECT query_id, CAST(run AS INTEGER) AS run, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text) AS run FROM m) WHERE run <= 8""")
def alias_expand(spark, sf_dir):
    names = spark.sql(f"SELECT group_id, name FROM {_ALIASES[:-1]}) AS a(group_id, name)")
    return rules.alias_queries(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")), names)


@query(f"WITH {_ISBNS} SELECT p_partkey, unnest([thirteen, ten]) AS digits, CAST(unnest([7, 27]) AS INTEGER) AS s, CAST(unnest([24, 37]) AS INTEGER) AS e FROM i")
def isbn_scan(spark, sf_dir):
    t = F.col("thirteen")
    part = lambda a, n: F.substring(t, a, n)
    hyphened = F.concat_ws("-", part(1, 3), part(4, 1), part(5, 3), part(8, 5), part(13, 1))
    found = _isbns(spark, sf_dir).select("p_partkey", F.explode(isbn.scan_udf(F.concat(F.lit("ISBNs: "), hyphened, F.lit(" / "), "ten", F.lit(" (pbk.)")))).alias("x"))
    return found.select("p_partkey", "x.digits", "x.s", "x.e")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section
    FROM events QUALIFY section IS NOT NULL""")
def section_carry_forward(spark, sf_dir):
    from pyspark.sql import Window as W

    down = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    section = F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(down)
    return table(spark, sf_dir, "events").select("user_id", "event_id", section.alias("section")).filter("section is not null")


@query(f"WITH {_UNITS}, {_POSTED} SELECT query_id, row_id, count(*) AS hits FROM (SELECT query_id, row_id FROM units JOIN posted ON word = term UNION ALL SELECT query_id, row_id FROM units JOIN posted ON last AND length(word) >= 3 AND starts_with(term, word) AND length(term) > length(word)) GROUP BY 1, 2")
def union_lookups(spark, sf_dir):
    own = distinct(spark, sf_dir)
    return own.spread(own.hits.unionByName(match.prefix_hits(own.units, own.posted)).groupBy("query_id", "row_id").agg(F.count(F.lit(1)).alias("hits")))


@query("SELECT o_orderpriority AS tab, count(*) AS rows FROM orders GROUP BY 1")
def tab_row_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("tab")).agg(F.count(F.lit(1)).alias("rows"))


@query()
def full_postings(spark, sf_dir):
    """Words of benchmark texts with every other form they are found by."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    return index.full_postings(texts)


@query()
def folded_titles(spark, sf_dir):
    """Distinct display titles, folded with accents, ligatures and symbols."""
    titles = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return titles.select("page_id", folding.display_title_udf(F.col("title")).alias("shown"), folding.fold_udf(F.col("title")).alias("folded"))


@query("""WITH r AS (SELECT event_type AS tab, CAST(user_id AS VARCHAR) AS fingerprint FROM events), p AS (SELECT tab, count(*) AS n FROM r GROUP BY 1)
    SELECT 'missing tab' AS tab, 'missing' AS problem, CAST(0 AS BIGINT) AS rows UNION ALL SELECT tab, 'noSchoolCode', n FROM p WHERE tab <> 'click'
    UNION ALL SELECT tab, 'repeatedRow', CAST(sum(n) AS BIGINT) FROM (SELECT tab, fingerprint, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def list_problems(spark, sf_dir):
    codes = F.when(F.col("event_type") == "click", F.array(F.lit("UAS"))).otherwise(F.array(F.lit("KES")))
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("tab"), F.col("event_id").alias("row"), F.col("user_id").cast("string").alias("fingerprint"), codes.alias("codes"))
    wanted = own.select("tab").distinct().unionByName(spark.sql("SELECT 'missing tab' AS tab"))
    return quality.problems(own, wanted)


@query()
def whole_search(spark, sf_dir):
    """All rules of the search at once; by SQL its parts are checked, as a whole the tests do."""
    from .judge_queries import asked as by_parts  # every part whose key is divisible by 100 asks
    from .judge_queries import listed

    asks = repeats.once(by_parts(spark, sf_dir), "query_id", "text", small=True)
    lists = repeats.once(listed(spark, sf_dir), "id", "title", "author")
    rated = find.rated(asks.one, find.build(kept(lists.one, "listed")).kept())
    return repeats.spread(find.placed(repeats.spread(rated, rows=lists)), asks, staged=False)


@query(f"""WITH {_ISBNS}, q AS (SELECT p_partkey AS query_id, thirteen AS t FROM i WHERE p_partkey % 100 = 0), s AS (SELECT p_partkey AS query_id, left(ten, 7) AS t FROM i WHERE p_partkey % 100 = 0)
    SELECT query_id, i.p_partkey AS row_id, CAST(3 AS INTEGER) AS tier FROM q JOIN i ON i.thirteen = q.t
    UNION SELECT -query_id - 1, i.p_partkey, CAST(2 AS INTEGER) FROM s JOIN i ON starts_with(i.ten, s.t) OR starts_with(i.thirteen, s.t)""")
def isbn_search(spark, sf_dir):
    """Whole ISBNs of the other form within a text, and (query ids below zero) the first digits of others."""
    own = _isbns(spark, sf_dir)
    some = own.filter("p_partkey % 100 = 0")
    whole = some.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("is ISBN "), "thirteen", F.lit(" listed?")).alias("text"))
    begun = some.select((-F.col("p_partkey") - 1).alias("query_id"), F.substring("ten", 1, 7).alias("text"))
    return find.isbn_hits(whole.unionByName(begun), own.select(F.col("p_partkey").alias("row_id"), F.col("ten").alias("isbn")))


_BENCHMARK = f"SELECT DISTINCT unnest({_WORDS.format('text')}) AS term FROM benchmark"


@query(f"""WITH t AS ({_BENCHMARK}), w AS (SELECT DISTINCT substr(term, 1, length(term) - 3) AS word FROM t WHERE length(term) >= 7),
    p AS (SELECT word, term FROM w, t WHERE length(term) > length(word) AND NOT starts_with(term, word)) SELECT word, term FROM p
    WHERE least(damerau_levenshtein(word, left(term, length(word) - 1)), damerau_levenshtein(word, left(term, length(word))), damerau_levenshtein(word, left(term, length(word) + 1))) <= 1""")
def search_near_starts(spark, sf_dir):
    """Words that are being typed, and the longer ones that begin as they do but for one edit."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(native.words(F.col("text"))).alias("term")).distinct()
    typed = terms.filter(F.length("term") >= 7).select(F.substring("term", F.lit(1), F.length("term") - 3).alias("word")).distinct()
    return find.near_starts(typed, terms)
