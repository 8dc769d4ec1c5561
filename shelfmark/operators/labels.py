"""Labels with numbers and ranges of numbers (J6, T11): an interval join by bins, in place of a term for each number of a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import LABELS

_PAIR = ["query_id", "row_id"]
#: Numbers of a bin.
BIN = 64
_RANGE = r"(?i)(?<!\p{L})(\p{L}+)\.?\s*#?\s*([0-9]{1,6})(?![0-9])(?:\s*(?:-|–|—|to|through|thru)\s*(?:\p{L}+\.?\s*)?([0-9]{1,6})(?![0-9]))?"


def _label(word: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.lower(word)]


def ranges(cells: DataFrame, text: str) -> DataFrame:
    """(the other columns, label, low, high) of each label with a number, or with a range, in a text. A range that falls is its first number."""
    parts = [F.regexp_extract_all(text, F.lit(_RANGE), F.lit(k)) for k in (1, 2, 3)]
    own = cells.select(*[c for c in cells.columns if c != text], F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc", strict=True)])).alias("x"))
    low, high = F.col("x.b").cast("int"), F.try_to_number("x.c", F.lit("999999")).cast("int")
    return own.select(*[c for c in cells.columns if c != text], _label(F.col("x.a")).alias("label"), low.alias("low"), F.when(high >= low, high).otherwise(low).alias("high")).filter("label IS NOT NULL").distinct()


def label_hits(asked: DataFrame, listed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, row_id, label, kind): exact where a listed number or range meets what is asked; loose where a candidate row has the label
    with other numbers only.

    asked: (query_id, label, low, high); listed: (row_id, label, low, high); candidates: (query_id, row_id). Both sides are cut into
    bins of BIN numbers, so that the join is on (label, bin) and a long range is a few rows.
    """

    def binned(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN))))

    typed = asked.select("query_id", "label", F.col("low").alias("from"), F.col("high").alias("to"))
    met = binned(typed, "from", "to").join(binned(listed, "low", "high"), ["label", "bin"]).filter("low <= to AND from <= high")
    exact = met.select(*_PAIR, "label").distinct()
    other = candidates.select(*_PAIR).distinct().join(typed.select("query_id", "label").distinct(), "query_id").join(listed.select("row_id", "label").distinct(), ["row_id", "label"])
    loose = other.select(*_PAIR, "label").join(exact, [*_PAIR, "label"], "left_anti")
    return exact.withColumn("kind", F.lit("exact")).unionByName(loose.withColumn("kind", F.lit("loose")))
