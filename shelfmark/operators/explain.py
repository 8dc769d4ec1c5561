"""Why a row was found, in which fields, and what else a reader may try."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import FIELDS
from .match import asked_terms
from .rules import acronyms

MOST_REASONS = 6
#: Order of fields in results.
_SHOWN = ("title", "author", "isbn", "memo", "type", "banned_by")
_ORDER = {"edit1": 0, "edit2": 0, "compound": 1, "alt": 2}


def reasons(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """(query_id, row_id, reasons, fields): spellings first, then joined words, then other forms; at most six, none twice.

    A row that is found by the typed words alone has no reasons.
    """
    assert set(_SHOWN) == set(FIELDS)
    vocabulary = posted.filter(F.col("term").rlike("^[a-z]+$")).select("term")
    terms = asked_terms(asked, vocabulary).join(asked.select("query_id", "unit", "word"), ["query_id", "unit"])
    hits = terms.join(posted.select("term", "row_id", "field"), "term").filter((F.col("kind") != "alt") | F.col("field").isin("title", "author", "memo"))
    typed = hits.filter("kind = 'exact'").select("query_id", "row_id", "unit").distinct().withColumn("typed", F.lit(True))
    text = (
        F.when(F.col("kind").startswith("edit"), F.concat(F.lit("similar spelling: "), "term"))
        .when(F.col("kind") == "compound", F.concat(F.lit("written as: "), "term"))
        .when(F.col("kind") == "alt", F.concat("word", F.lit(" = "), "term"))
    )
    place = F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv])[F.col("kind")]
    told = hits.join(typed, ["query_id", "row_id", "unit"], "left").withColumn("reason", F.when(F.col("typed").isNull(), F.struct(place.alias("place"), "unit", text.alias("text"))))
    number = F.create_map(*[x for k, f in enumerate(_SHOWN) for x in (F.lit(f), F.lit(k))])[F.col("field")]
    per_row = told.groupBy("query_id", "row_id").agg(F.array_sort(F.collect_set("reason")).alias("all"), F.array_sort(F.collect_set(F.struct(number.alias("n"), "field"))).alias("found"))
    texts = F.slice(F.array_distinct(F.transform("all", lambda r: r["text"])), 1, MOST_REASONS)
    return per_row.select("query_id", "row_id", texts.alias("reasons"), F.transform("found", lambda f: f["field"]).alias("fields"))


def hints(queries: DataFrame, asked: DataFrame, found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, code, text): keep typing after one or two letters; a term of the list that is the query's initials.

    queries: (query_id, text); found: (query_id, row_id, tier); dictionary: (term).
    """
    listed = found.filter("tier = 3").select("query_id").distinct()
    open_ = queries.join(listed, "query_id", "left_anti")
    short = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("word")).alias("longest")).filter("n = 1 and longest < 3")
    typing = open_.join(short, "query_id", "left_semi").select("query_id", F.lit("keepTyping").alias("code"), F.lit("Keep typing, or press Enter to search for this as it is.").alias("text"))
    initials = acronyms(open_, dictionary).filter(F.length("term") >= 3).groupBy("query_id").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("term"))
    return typing.unionByName(initials.select("query_id", F.lit("acronym").alias("code"), F.col("term").alias("text")))
