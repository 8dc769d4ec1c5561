"""The catalogue's queries by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..functions.vocabulary import ABBREVIATED, BRITISH, IRREGULAR, SMALL
from ..operators import changes, extract, index, match, rank, repeats, screen
from ..operators.staging import kept
from ..streaming.refresh import counted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Every part whose key is divisible by 100 asks: its name as it is, among small words, cut short, with another part's noun, run together, or with letters swapped.
_ASKS = """CASE CAST(floor(p_partkey / 100) AS INTEGER) % 7 WHEN 1 THEN 'the ' || p_name || ' of' WHEN 2 THEN substr(p_name, 1, length(p_name) - 1) WHEN 3 THEN 'Gizmo ' || p_name || ' rod'
    WHEN 4 THEN replace(p_name, ' ', '') WHEN 5 THEN substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3) WHEN 6 THEN 'the of' ELSE p_name END"""
ASKED = f"(SELECT p_partkey AS query_id, {_ASKS} AS text FROM part WHERE p_partkey % 100 = 0)"
_SMALL = ", ".join(f"'{w}'" for w in SMALL)
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_UNITS = f"""u0 AS (SELECT query_id, unnest(range(len(ws))) AS unit, unnest(ws) AS word FROM (SELECT query_id, {_WORDS.format('text')} AS ws FROM {ASKED} AS q(query_id, text))),
units AS (SELECT *, (word NOT IN ({_SMALL}) OR NOT max(word NOT IN ({_SMALL})) OVER (PARTITION BY query_id)) AS required, unit = max(unit) OVER (PARTITION BY query_id) AS last FROM u0)"""
_POSTED = f"posted AS (SELECT p_partkey AS row_id, unnest(range(len(ws))) AS wi, unnest(ws) AS term FROM (SELECT p_partkey, {_WORDS.format('p_name')} AS ws FROM part))"


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.expr(_ASKS).alias("text"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.listing(table(spark, sf_dir, "part"))


def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(rows(spark, sf_dir))


@dataclass
class Distinct:
    """The texts that ask and the titles that are listed, each once."""

    asks: repeats.Once
    lists: repeats.Once

    @property
    def units(self) -> DataFrame:
        return match.units(self.asks.one)

    @property
    def posted(self) -> DataFrame:
        return index.postings(self.lists.one)

    @property
    def hits(self) -> DataFrame:
        return match.exact_hits(self.units, self.posted)

    def tiered(self) -> DataFrame:
        return match.tiers(match.best_hits(self.hits), self.units)

    def spread(self, found: DataFrame) -> DataFrame:
        return repeats.spread(found, self.asks, self.lists)


def distinct(spark: SparkSession, sf_dir: str) -> Distinct:
    return Distinct(repeats.once(asked(spark, sf_dir), "query_id", "text", small=True), repeats.once(rows(spark, sf_dir), "id", "title"))


# --- index ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_POSTED} SELECT term, row_id, CAST(wi AS INTEGER) AS wi FROM posted")
def token_postings(spark, sf_dir):
    return posted(spark, sf_dir).select("term", "row_id", "wi")


@query(f"""WITH {_POSTED} SELECT term, count(*) AS postings, count(DISTINCT row_id) AS rows, min(row_id) AS first_row,
    CAST(arg_min(wi, row_id * 1000 + wi) AS INTEGER) AS first_wi FROM posted GROUP BY term""")
def term_dictionary(spark, sf_dir):
    return index.dictionary(posted(spark, sf_dir))


@query(f"""WITH w AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS term FROM documents)
    SELECT CAST(length(term) AS INTEGER) AS n, count(*) AS terms FROM w WHERE regexp_full_match(term, '[a-z]+') GROUP BY 1""")
def vocab_by_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    return index.vocabulary(index.postings(docs)).groupBy("n").agg(F.count(F.lit(1)).alias("terms"))


@query(f"""WITH {_POSTED} SELECT term || next AS term, row_id, CAST(wi AS INTEGER) AS wi FROM
    (SELECT *, lead(term) OVER (PARTITION BY row_id ORDER BY wi) AS next FROM posted) WHERE next IS NOT NULL""")
def compound_postings(spark, sf_dir):
    return index.compounds(posted(spark, sf_dir)).select("term", "row_id", "wi")


@query(f"""SELECT group_key, count(*) AS rows, count(DISTINCT p_brand) AS codes FROM
    (SELECT p_brand, array_to_string(list_filter({_WORDS.format('p_name')}, lambda w: w NOT IN ({_SMALL})), ' ') AS group_key FROM part) GROUP BY 1""")
def group_rows(spark, sf_dir):
    keyed = rows(spark, sf_dir).select("banned_by", index.group_key(F.col("title")).alias("group_key"))
    return keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("banned_by").alias("codes"))


# --- search --------------------------------------------------------------------------------------------------------


@query(f"WITH {_UNITS} SELECT query_id, CAST(unit AS INTEGER) AS unit, word, required, last FROM units")
def query_units(spark, sf_dir):
    return match.units(asked(spark, sf_dir))


@query(f"""WITH {_UNITS}, {_POSTED} SELECT query_id, row_id FROM units JOIN posted ON word = term
    GROUP BY query_id, row_id HAVING count(DISTINCT unit) = (SELECT count(*) FROM units v WHERE v.query_id = units.query_id)""")
def search_exact_all_words(spark, sf_dir):
    own = distinct(spark, sf_dir)
    return own.spread(match.all_of(own.hits, own.units))


@query(f"""WITH {_UNITS}, {_POSTED} SELECT query_id, row_id, term FROM units JOIN posted
    ON last AND length(word) >= 3 AND starts_with(term, word) AND length(term) > length(word)""")
def search_prefix_last_word(spark, sf_dir):
    own = posted(spark, sf_dir)
    return match.prefix_hits(match.units(asked(spark, sf_dir)), own).join(own, ["row_id", "field", "wi"]).select("query_id", "row_id", "term")


_NEAR = """WITH b AS (SELECT DISTINCT unnest({w0}) AS word FROM benchmark), d AS (SELECT DISTINCT unnest({w1}) AS term FROM {listed}),
p AS (SELECT word, term, CASE WHEN least(length(word), length(term)) <= 3 THEN 0 WHEN least(length(word), length(term)) <= 7 THEN 1 ELSE 2 END AS k
      FROM b, d WHERE word <> term AND length(word) >= 4 AND length(term) >= 4 AND (substr(word, 1, 1) = substr(term, 1, 1) OR substr(word, 2, 1) = substr(term, 2, 1)))
SELECT word, term, CAST(levenshtein(word, term) AS INTEGER) AS edits FROM p WHERE abs(length(word) - length(term)) <= k AND levenshtein(word, term) <= k"""


@query(_NEAR.format(w0=_WORDS.format("text"), w1=_WORDS.format("text"), listed="documents"))
def search_fuzzy_levenshtein_block(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(native.words(F.col("text"))).alias("word")).distinct()
    return match.near_terms(words, _vocabulary(spark, sf_dir).select(F.col("word").alias("term")), plain_levenshtein=True)


@query(_NEAR.format(w0=_WORDS.format("text"), w1=_WORDS.format("text"), listed="benchmark").replace("levenshtein", "damerau_levenshtein"))
def search_fuzzy_osa(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(native.words(F.col("text"))).alias("word")).distinct()
    return match.near_terms(words, words.select(F.col("word").alias("term")))


_TIERS = f"""WITH {_UNITS}, {_POSTED}, hits AS (SELECT DISTINCT query_id, unit, row_id FROM units JOIN posted ON word = term WHERE required),
    total AS (SELECT query_id, count(*) AS required FROM units WHERE required GROUP BY 1),
    found AS (SELECT query_id, row_id, count(*) AS strong, any_value(required) AS required FROM hits JOIN total USING (query_id) GROUP BY 1, 2)"""


@query(f"{_TIERS} SELECT query_id, row_id, CASE WHEN strong = required THEN 3 ELSE 1 END AS tier, strong, required FROM found WHERE strong * 2 >= required")
def tiered_search(spark, sf_dir):
    own = distinct(spark, sf_dir)
    return own.spread(own.tiered().select("query_id", "row_id", "tier", "strong", "required"))


@query(f"{_TIERS} SELECT query_id, count(*) AS rows FROM found WHERE strong < required AND strong * 2 >= required GROUP BY 1")
def possible_half_words(spark, sf_dir):
    own = distinct(spark, sf_dir)
    copies = own.lists.every.groupBy(F.col("first").alias("row_id")).agg(F.count(F.lit(1)).alias("copies"))
    found = own.tiered().filter("tier = 1").join(copies, "row_id").groupBy("query_id").agg(F.sum("copies").alias("rows"))
    return repeats.spread(found, own.asks)


@query()
def full_search(spark, sf_dir):
    """Exact, alternate, typed, joined, split and misspelt words at once."""
    own = distinct(spark, sf_dir)
    return own.spread(match.search(own.asks.one, own.posted))


@query(f"""WITH {_UNITS}, {_POSTED}, own AS (SELECT DISTINCT row_id, term FROM posted), n AS (SELECT row_id, count(*) AS items FROM own GROUP BY 1),
    q AS (SELECT DISTINCT query_id, word FROM units)
    SELECT query_id, row_id, items FROM (SELECT query_id, row_id, count(*) AS hit FROM own JOIN q ON word = term GROUP BY 1, 2) JOIN n USING (row_id) WHERE hit = items""")
def reverse_containment(spark, sf_dir):
    own = distinct(spark, sf_dir)
    return own.spread(match.contained_titles(own.asks.one, own.posted))


@query(f"""WITH {_UNITS}, {_POSTED} SELECT DISTINCT query_id, row_id FROM posted JOIN units ON word = term AND required""")
def semi_join_candidates(spark, sf_dir):
    own = distinct(spark, sf_dir)
    return own.spread(match.candidates(own.hits, own.units))


@query(f"""{_TIERS}, k AS (SELECT p_partkey AS row_id, array_to_string(list_sort({_WORDS.format('p_type')}), ' ') || p_size AS group_key FROM part),
    main AS (SELECT query_id, row_id FROM found WHERE strong = required), g AS (SELECT DISTINCT query_id, group_key FROM main JOIN k USING (row_id))
    SELECT query_id, row_id FROM g JOIN k USING (group_key) EXCEPT SELECT query_id, row_id FROM main""")
def anti_join_siblings(spark, sf_dir):
    """Rows of the type and size of a match that are no match themselves."""
    own = distinct(spark, sf_dir)
    found = kept(own.tiered().filter("tier = 3").select("query_id", F.col("row_id").alias("first")), "found")
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.concat(index.author_key(F.col("p_type")), F.col("p_size").cast("string")).alias("group_key"))
    listed = keys.join(own.lists.every.withColumnRenamed("id", "row_id"), "row_id")
    groups = found.join(listed.select("first", "group_key").distinct(), "first").select("query_id", "group_key").distinct()
    return repeats.spread(match.siblings(found, listed, groups), own.asks, staged=False)


@query(f"""WITH {_UNITS}, {_POSTED}, hits AS (SELECT DISTINCT query_id, unit, row_id FROM units JOIN posted ON word = term)
    SELECT query_id, row_id FROM hits WHERE unit = 0 INTERSECT SELECT query_id, row_id FROM hits WHERE unit = 1""")
def allof_intersection(spark, sf_dir):
    own = distinct(spark, sf_dir)
    part = lambda k: own.hits.filter(F.col("unit") == k).select("query_id", "row_id")
    return own.spread(part(0).intersect(part(1)))


@query(f"""WITH {_UNITS}, {_POSTED}, hits AS (SELECT DISTINCT query_id, unit, row_id FROM units JOIN posted ON word = term)
    SELECT query_id, row_id FROM hits WHERE unit = 0 EXCEPT SELECT query_id, row_id FROM hits WHERE unit = 1""")
def set_difference(spark, sf_dir):
    own = distinct(spark, sf_dir)
    part = lambda k: own.hits.filter(F.col("unit") == k).select("query_id", "row_id")
    return own.spread(part(0).subtract(part(1)))


_RANKED = f"""{_TIERS}, r AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN strong = required THEN 3 ELSE 1 END DESC, strong DESC, row_id) AS rank
    FROM found WHERE strong * 2 >= required),
    k AS (SELECT p_partkey AS row_id, array_to_string(list_filter({_WORDS.format('p_name')}, lambda w: w NOT IN ({_SMALL})), ' ') AS group_key FROM part),
    g AS (SELECT *, min(rank) OVER (PARTITION BY query_id, group_key) AS group_rank, count(*) OVER (PARTITION BY query_id, group_key) AS group_size FROM r JOIN k USING (row_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_rank, rank) AS place FROM g)"""


def _gathered(own: Distinct) -> DataFrame:
    """Ranks of all rows for each distinct text; all queries of this text have them."""
    keys = own.lists.one.select(F.col("id").alias("row_id"), index.group_key(F.col("title")).alias("group_key"))
    return rank.gathered(rank.ranked(repeats.spread(own.tiered().join(keys, "row_id"), rows=own.lists)))


@query(f"{_RANKED} SELECT query_id, row_id, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place, group_size FROM p")
def rank_group_gather(spark, sf_dir):
    own = distinct(spark, sf_dir)
    return repeats.spread(_gathered(own).select("query_id", "row_id", "rank", "place", "group_size"), own.asks, staged=False)


@query(f"""{_RANKED}, c AS (SELECT *, max(CASE WHEN place <= 50 THEN group_rank END) OVER (PARTITION BY query_id) AS last FROM p)
    SELECT query_id, row_id, CAST(place AS INTEGER) AS place FROM c WHERE group_rank <= last""")
def topk_no_group_split(spark, sf_dir):
    own = distinct(spark, sf_dir)
    return repeats.spread(rank.cut(_gathered(own), 50).select("query_id", "row_id", "place"), own.asks, staged=False)


@query("""SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place, greatest(n - 5, 0) AS more FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place <= 5""")
def top5_with_more(spark, sf_dir):
    return rank.top_with_more(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "place", "more")


# --- screening -----------------------------------------------------------------------------------------------------

_KEY = "regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '')"
_VERDICTS = f"""i AS (SELECT o_orderkey AS item_id, o_orderpriority AS tab, {_KEY.format("CASE WHEN o_orderkey % 4 = 0 THEN 'The ' || p_name || ' (copy)' WHEN o_orderkey % 11 = 0 THEN '!' ELSE p_name || CASE WHEN o_orderkey % 3 = 0 THEN ' x' ELSE '' END END").replace("lower(", "lower(regexp_replace(", 1).replace(" END END)", " END END, ' [(]copy[)]', ''))", 1)} AS key
      , CASE o_orderkey % 5 WHEN 0 THEN 'annlee' WHEN 1 THEN '' ELSE 'boking' END AS author, CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey % 200 + 2 AS VARCHAR) ELSE '' END AS isbn
      FROM orders JOIN part ON p_partkey = o_orderkey % 200 + 1),
    l AS (SELECT {_KEY.format('p_name')} AS key, CASE p_partkey % 3 WHEN 0 THEN 'annlee' WHEN 1 THEN 'boking' ELSE '' END AS author, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS isbn, count(*) AS n FROM part GROUP BY 1, 2, 3),
    ik AS (SELECT DISTINCT key, author, isbn FROM i), ki AS (SELECT DISTINCT key FROM i), kl AS (SELECT DISTINCT key FROM l),
    ins AS (SELECT ki.key AS k, kl.key AS inside FROM ki JOIN kl ON ki.key <> kl.key AND contains(kl.key, ' ') AND len(list_distinct(string_split(kl.key, ' '))) >= 2 AND list_has_all(string_split(ki.key, ' '), string_split(kl.key, ' '))),
    h AS (SELECT ik.key, ik.author, ik.isbn, l.key AS rk, l.author AS ra, l.isbn AS ri, n, CASE WHEN ik.author = '' OR l.author = '' OR ik.author = l.author THEN 2 ELSE 1 END AS strength FROM ik JOIN l ON ik.key = l.key AND ik.key <> ''
      UNION ALL SELECT ik.key, ik.author, ik.isbn, l.key, l.author, l.isbn, n, 2 FROM ik JOIN l ON ik.isbn = l.isbn AND ik.isbn <> ''
      UNION ALL SELECT ik.key, ik.author, ik.isbn, l.key, l.author, l.isbn, n, 1 FROM ik JOIN ins ON ins.k = ik.key JOIN l ON l.key = ins.inside),
    g AS (SELECT key, author, isbn, rk, ra, ri, n, max(strength) AS strength FROM h GROUP BY ALL),
    s AS (SELECT key, author, isbn, CAST(sum(CASE WHEN strength = 2 THEN n ELSE 0 END) AS BIGINT) AS likely, CAST(sum(CASE WHEN strength = 1 THEN n ELSE 0 END) AS BIGINT) AS look FROM g GROUP BY 1, 2, 3),
    v AS (SELECT item_id, tab, CASE WHEN likely > 0 THEN 'likely' WHEN look > 0 THEN 'look' WHEN key = '' AND isbn = '' THEN 'skipped' ELSE 'clear' END AS verdict, coalesce(likely, 0) AS likely, coalesce(look, 0) AS look
      FROM i LEFT JOIN s USING (key, author, isbn))"""


def _screened(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("o_orderkey")
    plain = F.concat("p_name", F.when(k % 3 == 0, " x").otherwise(""))
    title = F.when(k % 4 == 0, F.concat(F.lit("The "), "p_name", F.lit(" (copy)"))).when(k % 11 == 0, "!").otherwise(plain)
    items = table(spark, sf_dir, "orders").join(part, F.col("p_partkey") == k % 200 + 1)
    author = F.when(k % 5 == 0, "Ann Lee").when(k % 5 == 1, "").otherwise("Bo King")
    isbn = F.when(k % 13 == 0, (k % 200 + 2).cast("string")).otherwise("")
    items = items.select(k.alias("item_id"), F.col("o_orderpriority").alias("tab"), title.alias("title"), author.alias("author"), isbn.alias("isbn"))
    n = F.col("p_partkey")
    by = F.when(n % 3 == 0, "Ann Lee").when(n % 3 == 1, "Bo King").otherwise("")
    listed = part.select(n.alias("row_id"), F.col("p_name").alias("title"), by.alias("author"), F.when(n % 2 == 0, n.cast("string")).otherwise("").alias("isbn"))
    return screen.verdicts(items, listed)


@query(f"WITH {_VERDICTS} SELECT * FROM v")
def batch_screening(spark, sf_dir):
    return _screened(spark, sf_dir)


@query(f"""WITH {_VERDICTS} SELECT coalesce(tab, '*') AS tab, count(*) AS items, count(*) FILTER (verdict = 'likely') AS likely, count(*) FILTER (verdict = 'look') AS look,
    count(*) FILTER (verdict = 'clear') AS clear, count(*) FILTER (verdict = 'skipped') AS skipped FROM v GROUP BY ROLLUP (tab)""")
def screening_report(spark, sf_dir):
    return screen.report(_screened(spark, sf_dir))


# --- list fields ---------------------------------------------------------------------------------------------------

_CODES = "(VALUES (0, 'Ministry'), (1, 'UAS / Minstry'), (2, 'kes, KES and abc'), (3, 'n/a'), (4, 'M.O.E.'), (5, 'Industry'), (6, 'uas'))"


@query(f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'ministry' WHEN 1 THEN 'ministry' WHEN 2 THEN 'other' WHEN 3 THEN 'blank' WHEN 4 THEN 'ministry' WHEN 5 THEN 'other' ELSE 'uas' END AS level,
    CASE p_partkey % 7 WHEN 0 THEN 'Ministry' WHEN 1 THEN 'UAS|Ministry' WHEN 2 THEN 'KES|ABC' WHEN 3 THEN '' WHEN 4 THEN 'Ministry' WHEN 5 THEN 'Industry' ELSE 'UAS' END AS codes FROM part""")
def status_from_code(spark, sf_dir):
    codes = spark.sql(f"SELECT k, code FROM {_CODES[:-1]}) AS c(k, code)")
    own = table(spark, sf_dir, "part").join(codes, F.col("p_partkey") % 7 == F.col("k"))
    return own.select("p_partkey", extract.status(F.col("code")).alias("s")).select("p_partkey", "s.level", F.array_join("s.codes", "|").alias("codes"))


@query("SELECT upper(p_brand) AS code, count(*) AS n FROM part GROUP BY 1")
def code_counts(spark, sf_dir):
    codes = rows(spark, sf_dir).select(F.explode(extract.status(F.col("banned_by"))["codes"]).alias("code"))
    return codes.groupBy(F.upper("code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#1', 'Brand#3')")
def filter_by_codes(spark, sf_dir):
    status = extract.status(F.col("banned_by"))["codes"]
    return rows(spark, sf_dir).filter((F.size(status) == 0) | F.arrays_overlap(status, F.array(F.lit("Brand#1"), F.lit("Brand#3")))).select("id")


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name || ', The' WHEN 1 THEN '  An  ' || p_name || ' (disc)' WHEN 2 THEN upper(p_name) || '!' ELSE p_name END"


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("title"))


@query(f"SELECT p_partkey, regexp_replace(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), '^(.*), (The|A|An)$', '\\2 \\1') AS title FROM part")
def title_display_article(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", native.plain_display_title(F.col("title")).alias("title"))


@query(f"SELECT p_partkey, {_KEY.format('p_name')} AS key FROM part")
def title_key(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", native.title_key(F.col("title")).alias("key"))


_VOCAB = f"w AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS word FROM documents)"


def _vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(native.words(F.col("text"))).alias("word")).distinct()


def _sql_map(pairs: dict[str, str]) -> str:
    both = pairs | {b: a for a, b in pairs.items()}
    return "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in both.items()) + " END"


def _rx(pattern: str) -> str:
    return f"regexp_matches(word, '(?:{pattern})$')"


_LEFT = "left(word, length(word) - {0})"
_PLURALS = [
    _sql_map(IRREGULAR),
    f"CASE WHEN length(word) >= 4 AND {_rx('ies')} THEN {_LEFT.format(3)} || 'y' END",
    f"CASE WHEN length(word) >= 4 AND {_rx('ies')} THEN {_LEFT.format(1)} END",
    f"CASE WHEN length(word) >= 4 AND {_rx('ves')} THEN {_LEFT.format(3)} || 'f' END",
    f"CASE WHEN length(word) >= 4 AND {_rx('ves')} THEN {_LEFT.format(3)} || 'fe' END",
    f"CASE WHEN length(word) >= 4 AND {_rx('ves')} THEN {_LEFT.format(1)} END",
    f"CASE WHEN length(word) >= 4 AND NOT {_rx('ies|ves')} AND {_rx('(?:s|x|z|ch|sh)es')} THEN {_LEFT.format(2)} END",
    f"CASE WHEN length(word) >= 4 AND NOT {_rx('ies|ves')} AND NOT {_rx('(?:s|x|z|ch|sh)es')} AND {_rx('s')} AND NOT {_rx('ss|us|is')} THEN {_LEFT.format(1)} END",
    f"CASE WHEN length(word) >= 6 AND {_rx('[^aeiou]oes')} THEN {_LEFT.format(2)} END",
    f"CASE WHEN length(word) < 4 THEN NULL WHEN {_rx('[^aeiou]y')} THEN {_LEFT.format(1)} || 'ies' WHEN {_rx('fe')} THEN {_LEFT.format(2)} || 'ves' WHEN {_rx('f')} THEN {_LEFT.format(1)} || 'ves' WHEN {_rx('(?:s|x|z|ch|sh)')} THEN word || 'es' ELSE word || 's' END",
    f"CASE WHEN length(word) >= 4 AND {_rx('[^aeiou]o')} THEN word || 'es' END",
]


@query(f"WITH {_VOCAB} SELECT word, coalesce(array_to_string([{', '.join(_PLURALS)}], ' '), '') AS forms FROM w")
def plural_forms(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("word", F.array_join(native.plural_forms(F.col("word")), " ").alias("forms"))


def _sql_swap(floor: int, pattern: str, new: str, unless: str = "") -> str:
    also = f" AND NOT regexp_matches(word, '{unless}')" if unless else ""
    return f"CASE WHEN length(word) >= {floor} AND regexp_matches(word, '{pattern}'){also} THEN regexp_replace(word, '{pattern}', '{new}') END"


_ISE = "(e|ed|es|ing|ation|ations|er|ers)$"
_BRITISH = [
    _sql_map(BRITISH),
    f"coalesce({_sql_swap(5, '^(.+)our(s|ed|ite|ites)?$', '\\1or\\2', 'oor')}, {_sql_swap(5, '^(.+)or(s|ed|ite|ites)?$', '\\1our\\2', 'oor')})",
    f"coalesce({_sql_swap(6, f'^(.+)is{_ISE}', '\\1iz\\2')}, {_sql_swap(6, f'^(.+)iz{_ISE}', '\\1is\\2')})",
    f"coalesce({_sql_swap(5, '^(.+)tre(s?)$', '\\1ter\\2')}, {_sql_swap(5, '^(.+)ter(s?)$', '\\1tre\\2')})",
]


@query(f"WITH {_VOCAB} SELECT word, coalesce(array_to_string([{', '.join(_BRITISH)}], ' '), '') AS forms FROM w")
def british_american(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("word", F.array_join(native.british_american(F.col("word")), " ").alias("forms"))


@query(f"WITH {_VOCAB} SELECT word, {_sql_map(ABBREVIATED)} AS form FROM w WHERE {_sql_map(ABBREVIATED)} IS NOT NULL")
def abbreviations(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("word", native._two_way(ABBREVIATED, F.col("word")).alias("form")).filter("form is not null")


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\r\n|[\r\n\x0b\x0c]'), lambda l: regexp_matches(l, '[\pL\pN]'))) AS lines FROM documents""")
def split_lines(spark, sf_dir):
    parts = F.filter(F.split("text", r"\r\n|[\r\n\x0b\x0c]"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("bigint").alias("lines"))


@query(rf"""SELECT doc_id, CASE WHEN length(text) > 300 THEN array_to_string(list_filter(string_split(trim(regexp_replace(text, '[\s\x{{A0}}]+', ' ', 'g')), ' '), lambda w: lower(w) NOT IN ({_SMALL}))[1:12], ' ') ELSE text END AS query FROM documents""")
def truncate_long(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", native.truncated(F.col("text")).alias("query"))


# --- numbers and ISBN ----------------------------------------------------------------------------------------------

_CORE = "lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0')"
_CHECK10 = "(11 - (" + " + ".join(f"CAST(substr(core, {i + 1}, 1) AS INTEGER) * {10 - i}" for i in range(9)) + ") % 11) % 11"
_CHECK13 = "(10 - (" + " + ".join(f"CAST(substr('978' || core, {i + 1}, 1) AS INTEGER) * {3 if i % 2 else 1}" for i in range(12)) + ") % 10) % 10"
_ISBNS = f"i AS (SELECT p_partkey, core, core || CASE WHEN {_CHECK10} = 10 THEN 'x' ELSE CAST({_CHECK10} AS VARCHAR) END AS ten, '978' || core || CAST({_CHECK13} AS VARCHAR) AS thirteen FROM (SELECT p_partkey, {_CORE} AS core FROM part))"


def _isbns(spark, sf_dir):
    core = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    return table(spark, sf_dir, "part").select("p_partkey", core.alias("core")).select("p_partkey", native.check10(F.col("core")).alias("ten"), native.check13(F.concat(F.lit("978"), "core")).alias("thirteen"))


@query(f"WITH {_ISBNS} SELECT p_partkey, ten, thirteen FROM i")
def isbn_checkdigit(spark, sf_dir):
    return _isbns(spark, sf_dir)


@query(f"WITH {_ISBNS} SELECT p_partkey, '978' || left(ten, 9) AS of_ten, left(thirteen, 12) AS of_thirteen FROM i")
def isbn_key(spark, sf_dir):
    return _isbns(spark, sf_dir).select("p_partkey", native.isbn_key(F.col("ten")).alias("of_ten"), native.isbn_key(F.col("thirteen")).alias("of_thirteen"))


@query(f"""WITH {_ISBNS}, f AS (SELECT p_partkey, unnest([ten, thirteen]) AS form FROM i) SELECT DISTINCT q.start, p_partkey FROM f JOIN (SELECT left(ten, 7) AS start FROM i) q
    ON starts_with(form, q.start)""")
def isbn_prefix_search(spark, sf_dir):
    """Every part's first seven digits, against both forms of all."""
    own = _isbns(spark, sf_dir)
    forms = own.select("p_partkey", F.explode(native.isbn_forms(F.col("ten"))).alias("form"))
    typed = own.select(F.substring("ten", 1, 7).alias("start")).distinct()
    return typed.join(forms.withColumn("start", F.substring("form", 1, 7)), "start").select("start", "p_partkey").distinct()


@query("SELECT p_partkey, lower(regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1)) AS label, CAST(regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS INTEGER) AS number FROM part")
def label_number_pairs(spark, sf_dir):
    part = lambda k: F.regexp_extract("p_brand", "([A-Za-z]+)#([0-9]+)", k)
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(part(1)).alias("label"), part(2).cast("int").alias("number"))


@query("SELECT p_partkey, CAST(unnest(range(p_partkey % 7 + 1, p_partkey % 7 + 2 + p_size % 5)) AS BIGINT) AS volume FROM part")
def range_expand(spark, sf_dir):
    first = F.col("p_partkey") % 7 + 1
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(first, first + F.col("p_size") % 5)).alias("volume"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS start, CAST(year(o_orderdate) + 1 AS INTEGER) AS end FROM orders")
def year_range(spark, sf_dir):
    y = F.year("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("-", y, y + 1)).otherwise(F.concat(y.cast("string"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0")))
    return table(spark, sf_dir, "orders").select("o_orderkey", native.year_range(text).alias("r")).select("o_orderkey", "r.start", "r.end")


@query("SELECT p_partkey, CASE WHEN k >= 702 THEN chr(CAST(65 + (k - 26) // 676 - 1 AS INTEGER)) ELSE '' END || CASE WHEN k >= 26 THEN chr(CAST(65 + (k // 26 - 1) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + k % 26 AS INTEGER)) AS letter FROM (SELECT p_partkey, p_partkey % 1500 AS k FROM part)")
def column_letters(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", native.column_letter(F.col("p_partkey") % 1500).alias("letter"))


_CELL = "CASE p_partkey % 5 WHEN 0 THEN '=' || p_name WHEN 1 THEN p_name || ', \"x\"' WHEN 2 THEN '-' || p_brand ELSE p_name END"


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(c, '[",]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS cell FROM
    (SELECT p_partkey, CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END AS c FROM (SELECT p_partkey, {_CELL} AS v FROM part))""")
def csv_cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_CELL).alias("v")).select("p_partkey", native.csv_cell(F.col("v")).alias("cell"))


# --- snapshots, links, events --------------------------------------------------------------------------------------


def _versions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of = lambda k: events.filter(F.col("event_id") % 2 == k).select(F.col("event_type").alias("tab"), F.col("user_id").cast("string").alias("fingerprint"), F.col("event_id").alias("row"))
    return of(0), of(1)


@query("""WITH n AS (SELECT event_type AS tab, CAST(user_id AS VARCHAR) AS fingerprint, event_id, event_id % 2 AS v, row_number() OVER (PARTITION BY event_type, user_id, event_id % 2 ORDER BY event_id) AS nth FROM events)
    SELECT tab, fingerprint, CAST(nth AS INTEGER) AS nth, coalesce(max(CASE WHEN v = 0 THEN event_id END), -1) AS old_row, coalesce(max(CASE WHEN v = 1 THEN event_id END), -1) AS new_row FROM n GROUP BY 1, 2, 3""")
def snapshot_diff_kth(spark, sf_dir):
    return changes.paired(*_versions(spark, sf_dir)).fillna(-1, ["old_row", "new_row"])


_PART = "CAST(sum(CAST(CAST('0x' || substr(md5(t), {0}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"


@query(f"""SELECT tab, count(*) AS rows, {_PART.format(1)} || '-' || {_PART.format(16)} AS signature FROM
    (SELECT event_type AS tab, CAST(user_id AS VARCHAR) || chr(31) || CAST(event_id AS VARCHAR) AS t FROM events) GROUP BY tab""")
def snapshot_signature(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tab"), F.col("user_id").alias("fingerprint"), F.col("event_id").alias("row"))
    return changes.signature(rows, ["fingerprint", "row"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return counted(table(spark, sf_dir, "events"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^\\s/]+') THEN url END AS link, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def url_parse_https(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", native.https_only(F.col("url")).alias("link"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("SELECT page_id, regexp_matches(left(html, 200), '(?i)^\\s*<(?:!doctype|html|head|body)') AS is_html FROM pages")
def html_instead_of_data(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring("html", 1, 200).rlike("(?i)^\\s*<(?:!doctype|html|head|body)").alias("is_html"))
