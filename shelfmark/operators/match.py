"""Matching as joins (J1-J12), best hits and tiers (A1-A4).

The list's side is the index. Terms join by hash; prefixes and edits are given an equality to block on (the first three
letters; the first or second letter), so that no plan compares every word with every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import native
from ..functions.edits import budget, osa_udf
from ..functions.vocabulary import FIELD_WEIGHT, KIND_CLASS, KIND_WEIGHT

_CONTENT = ("title", "author", "memo", "isbn")


def units(queries: DataFrame) -> DataFrame:
    """Q1, Q2: (query_id, unit, word, required, last). Small words are required only where a query has no others."""
    words = queries.select("query_id", F.posexplode(native.words(F.col("text"))).alias("unit", "word"))
    w = W.partitionBy("query_id")
    own = ~native.is_small(F.col("word"))
    return words.select("query_id", "unit", "word", (own | ~F.max(own).over(w)).alias("required"), (F.col("unit") == F.max("unit").over(w)).alias("last"))


def exact_hits(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """Equal terms; postings of other forms say of which kind they are."""
    kind = F.col("kind") if "kind" in posted.columns else F.lit("exact")
    return asked.join(posted, F.col("word") == F.col("term")).select("query_id", "unit", "row_id", "field", "wi", kind.alias("kind"))


def alternate_hits(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """J1 through plural, singular, British and American forms, in the fields that allow them."""
    forms = asked.select("query_id", "unit", F.explode(F.array_distinct(F.concat(native.plural_forms(F.col("word")), native.british_american(F.col("word"))))).alias("term"))
    return forms.join(posted.filter(F.col("field").isin("title", "author", "memo")), "term").select("query_id", "unit", "row_id", "field", "wi", F.lit("alt").alias("kind"))


def prefix_hits(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """The last word of each query as the beginning of longer terms; three letters at least. Distinct terms meet the words, postings only what is found."""
    typed = asked.filter(F.col("last") & (F.length("word") >= 3)).withColumn("start", F.substring("word", 1, 3))
    longer = F.col("term").startswith(F.col("word")) & (F.length("term") > F.length("word"))
    terms = typed.join(posted.select("term").distinct().withColumn("start", F.substring("term", 1, 3)), "start").filter(longer).select("query_id", "unit", "term")
    return terms.join(posted, "term").select("query_id", "unit", "row_id", "field", "wi", F.lit("prefix").alias("kind"))


def near_terms(words: DataFrame, vocabulary: DataFrame, plain_levenshtein: bool = False) -> DataFrame:
    """(word, term, edits) within the budget of the shorter one; both start alike in the first or the second letter.

    words: (word); vocabulary: (term). The join is on distinct words, never on postings, and blocks on (place, letter, length).
    """

    def keyed(df: DataFrame, name: str, lengths: Column) -> DataFrame:
        letters = F.array(*[F.struct(F.lit(p).alias("place"), F.substring(name, p, 1).alias("letter")) for p in (1, 2)])
        return df.filter(F.length(name) >= 4).select(name, F.explode(lengths).alias("n"), letters.alias("all")).select(name, "n", F.explode("all").alias("k")).select(name, "n", "k.place", "k.letter").filter("letter <> ''")

    n = F.length("word")
    around = F.sequence(n - budget(n), n + budget(n))  # the shorter one's budget is no larger
    pairs = keyed(words.select("word").distinct(), "word", around).join(keyed(vocabulary.select("term").distinct(), "term", F.array(F.length("term"))), ["n", "place", "letter"])
    most = budget(F.least(F.length("word"), F.length("term")))
    near = pairs.filter((F.abs(F.length("word") - F.length("term")) <= most) & (F.col("word") != F.col("term"))).select("word", "term", most.alias("most")).distinct()
    bound = near.withColumn("plain", F.levenshtein("word", "term", 4)).filter((F.col("plain") >= 0) & (F.col("plain") <= F.col("most") * 2))  # alignment counts a swap once, Levenshtein twice
    edits = F.col("plain") if plain_levenshtein else osa_udf(F.col("word"), F.col("term"), F.col("most"))
    return bound.select("word", "term", "most", edits.alias("edits")).filter("edits <= most").drop("most")


def fuzzy_hits(asked: DataFrame, posted: DataFrame) -> DataFrame:
    near = near_terms(asked, posted.filter(F.col("term").rlike("^[a-z]+$")))
    kind = F.when(F.col("edits") == 1, "edit1").otherwise("edit2")
    return asked.join(near, "word").join(posted, "term").select("query_id", "unit", "row_id", "field", "wi", kind.alias("kind"))


def joined_hits(asked: DataFrame, compound: DataFrame) -> DataFrame:
    """One query word that the list writes as two."""
    return asked.join(compound, F.col("word") == F.col("term")).select("query_id", "unit", "row_id", "field", "wi", F.lit("compound").alias("kind"))


def split_hits(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """Two neighbouring query words that the list writes as one; the hit counts for both."""
    w = W.partitionBy("query_id").orderBy("unit")
    pairs = asked.withColumn("next", F.lead("word").over(w)).filter("next is not null").select("query_id", "unit", F.concat("word", "next").alias("term"))
    hits = pairs.join(posted, "term")
    return hits.select("query_id", F.explode(F.array("unit", F.col("unit") + 1)).alias("unit"), "row_id", "field", "wi", F.lit("compound").alias("kind"))


def _lookup(table: dict[str, int], column: str):
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column)]


def best_hits(hits: DataFrame) -> DataFrame:
    """A1: the best hit of each unit in each row; of equal ones the first by field and place."""
    meta = ~F.col("field").isin(*_CONTENT)
    value = F.when(meta, 3000).otherwise(_lookup(KIND_CLASS, "kind") * 1000) + _lookup(KIND_WEIGHT, "kind") * _lookup(FIELD_WEIGHT, "field") / 100
    ranked = hits.select("query_id", "row_id", "unit", F.struct((-value).alias("rank"), "field", "wi", "kind").alias("h"))
    best = ranked.groupBy("query_id", "row_id", "unit").agg(F.min("h").alias("h"), F.max(F.col("h.field").isin(*_CONTENT)).alias("content"))
    return best.select("query_id", "row_id", "unit", "h.field", "h.wi", "h.kind", (-F.col("h.rank")).cast("bigint").alias("value"), "content")


def candidates(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows where a required unit hits a content field."""
    needed = asked.filter("required").select("query_id", "unit")
    return hits.filter(F.col("field").isin(*_CONTENT)).join(needed, ["query_id", "unit"], "left_semi").select("query_id", "row_id").distinct()


def tiers(best: DataFrame, asked: DataFrame) -> DataFrame:
    """A2, A3: match where every required unit hits exactly, close where every one hits, possible where half do.

    A row counts only if a required unit hits one of its content fields (J10).
    """
    needed = asked.filter("required").select("query_id", "unit")
    total = needed.groupBy("query_id").agg(F.count(F.lit(1)).alias("required"))
    strong = _lookup(KIND_CLASS, "kind") == 3
    anchor = (_lookup(KIND_CLASS, "kind") >= 2) & F.col("field").isin(*_CONTENT)
    found = best.join(needed, ["query_id", "unit"], "left_semi").groupBy("query_id", "row_id").agg(
        F.count(F.lit(1)).alias("hit"), F.count_if(strong).alias("strong"), F.count_if(anchor).alias("anchors"), F.sum("value").cast("bigint").alias("quality"), F.max("content").alias("content")
    ).filter("content")
    tier = F.when((F.col("strong") == F.col("required")) & (F.col("anchors") > 0), 3).when(F.col("hit") == F.col("required"), 2).when(F.col("anchors") * 2 >= F.col("required"), 1)
    return found.join(total, "query_id").withColumn("tier", tier).filter("tier is not null").select("query_id", "row_id", "tier", "hit", "strong", "anchors", "required", "quality")


def asked_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, unit, term, kind): every term that a unit may stand for, so that one join with the postings finds them all."""
    own = asked.select("query_id", "unit", F.col("word").alias("term"), F.lit("exact").alias("kind"))
    forms = F.array_distinct(F.concat(native.plural_forms(F.col("word")), native.british_american(F.col("word"))))
    other = asked.select("query_id", "unit", F.explode(forms).alias("term"), F.lit("alt").alias("kind"))
    near = asked.join(near_terms(asked, vocabulary), "word").select("query_id", "unit", "term", F.when(F.col("edits") == 1, "edit1").otherwise("edit2").alias("kind"))
    near = near.join(other, ["query_id", "unit", "term"], "left_anti")  # grey is no misspelt gray
    w = W.partitionBy("query_id").orderBy("unit")
    pairs = asked.withColumn("next", F.lead("word").over(w)).filter("next is not null")
    joined = pairs.select("query_id", F.explode(F.array("unit", F.col("unit") + 1)).alias("unit"), F.concat("word", "next").alias("term"), F.lit("compound").alias("kind"))
    return own.unionByName(other).unionByName(near).unionByName(joined)


def search(queries: DataFrame, posted: DataFrame, unfinished: bool = True) -> DataFrame:
    """All queries over the index at once: the tier of each row that any of them finds."""
    asked = units(queries)
    vocabulary = posted.filter(F.col("term").rlike("^[a-z]+$")).select("term")
    listed_kind = F.when((F.col("asked_kind") == "exact") & F.lit("kind" in posted.columns), F.col("kind") if "kind" in posted.columns else F.lit("exact")).otherwise(F.col("asked_kind"))
    found = asked_terms(asked, vocabulary).withColumnRenamed("kind", "asked_kind").join(posted, "term")
    hits = found.filter((F.col("asked_kind") != "alt") | F.col("field").isin("title", "author", "memo")).select("query_id", "unit", "row_id", "field", "wi", listed_kind.alias("kind"))
    hits = hits.unionByName(joined_hits(asked, _compounds(posted.filter("field = 'title'"))))
    if unfinished:
        hits = hits.unionByName(prefix_hits(asked, posted))
    return tiers(best_hits(hits), asked)


def _compounds(posted: DataFrame) -> DataFrame:
    from .index import compounds

    return compounds(posted)


def all_of(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """U3s: the rows that every unit of the query hits."""
    total = asked.groupBy("query_id").agg(F.countDistinct("unit").alias("n"))
    found = hits.groupBy("query_id", "row_id").agg(F.countDistinct("unit").alias("hit"))
    return found.join(total, "query_id").filter("hit = n").select("query_id", "row_id")


def contained_titles(queries: DataFrame, posted: DataFrame) -> DataFrame:
    """A4: rows all of whose title words are in the query (division of relations)."""
    asked = queries.select("query_id", F.explode(F.array_distinct(native.words(F.col("text")))).alias("term"))
    items = posted.filter("field = 'title'").select("row_id", "term").distinct()
    n = items.groupBy("row_id").agg(F.count(F.lit(1)).alias("items"))
    found = items.join(asked, "term").groupBy("query_id", "row_id").agg(F.count(F.lit(1)).alias("hit"))
    return found.join(n, "row_id").filter("hit = items").select("query_id", "row_id", "items")


def siblings(found: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of groups that found rows are of, but for those found. found: (query_id, first); rows: (row_id, first, group_key), first being
    the row that is found or not in this one's place; groups: (query_id, group_key)."""
    return rows.join(groups, "group_key").select("query_id", "row_id", "first").join(found, ["query_id", "first"], "left_anti").select("query_id", "row_id").distinct()
