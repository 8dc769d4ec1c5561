"""The positional inverted index as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import native
from ..functions.words import terms_udf

FIELD_COLUMNS = ("title", "author", "memo", "type", "banned_by")


def listing(part: DataFrame) -> DataFrame:
    """The driver's parts as a list: names are titles, brands the codes that ban them."""
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("banned_by"), F.col("p_type").alias("type"))


def postings(rows: DataFrame, fields: tuple[str, ...] = ("title",)) -> DataFrame:
    """(term, row_id, field, wi): one row for each word of each field; wi is its place."""
    found = [F.struct(F.lit(f).alias("field"), native.words(F.col(f)).alias("words")) for f in fields]
    by_field = rows.select(F.col("id").alias("row_id"), F.explode(F.array(*found)).alias("x"))
    return by_field.select("row_id", "x.field", F.posexplode("x.words").alias("wi", "term")).select("term", "row_id", "field", "wi")


def full_postings(rows: DataFrame, fields: tuple[str, ...] = ("title",)) -> DataFrame:
    """B1: (term, row_id, field, wi, kind) of words and their other forms: numbers, initials, hyphened parts, labels with numbers."""
    out = None
    for f in fields:
        own = rows.select(F.col("id").alias("row_id"), F.lit(f).alias("field"), F.explode(terms_udf(F.col(f))).alias("x")).select("x.term", "row_id", "field", "x.wi", "x.kind")
        out = own if out is None else out.unionByName(own)
    return out


def compounds(posted: DataFrame) -> DataFrame:
    """B2: each two neighbouring words joined."""
    w = W.partitionBy("row_id", "field").orderBy("wi")
    pairs = posted.withColumn("next", F.lead("term").over(w)).filter("next is not null")
    return pairs.select(F.concat("term", "next").alias("term"), "row_id", "field", "wi")


def dictionary(posted: DataFrame) -> DataFrame:
    """Postings and rows of each term, and where it first occurs."""
    return posted.groupBy("term").agg(
        F.count(F.lit(1)).alias("postings"), F.countDistinct("row_id").alias("rows"), F.min(F.struct("row_id", "field", "wi")).alias("first")
    ).select("term", "postings", "rows", F.col("first.row_id").alias("first_row"), F.col("first.wi").alias("first_wi"))


def vocabulary(posted: DataFrame) -> DataFrame:
    """The distinct words of letters only, with their lengths."""
    return posted.filter(F.col("term").rlike("^[a-z]+$")).select("term", F.length("term").alias("n")).distinct()


def group_key(title: Column) -> Column:
    """The title's meaningful words."""
    return F.array_join(F.filter(native.words(title), lambda w: ~native.is_small(w)), " ")


def author_key(author: Column) -> Column:
    return F.array_join(F.array_sort(native.words(author)), " ")
