"""Rows of equal texts: what is asked of their texts is worked out once for each, and then goes to every row that has them.

A list of a million rows of a few thousand titles is searched as a list of these titles; only the result has a row for each row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import kept


@dataclass
class Once:
    """one: the rows under the least key of each text; every: (the key, first), each key once, first being the key in `one` that stands for it."""

    one: DataFrame
    every: DataFrame


def once(df: DataFrame, key: str, *texts: str, small: bool = False) -> Once:
    """Keys whose rows are equal in `texts` stand for each other; nulls are equal, and a key of several rows equals one of the same rows.

    small: stages the keys, where they are known to be few beside the rows that they are to meet.
    """
    own = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*texts))).alias("_texts"))
    first = kept(own.groupBy("_texts").agg(F.min(key).alias("first")), "first")
    one = df.join(first.select(F.col("first").alias(key)), key, "left_semi")
    every = own.join(first, "_texts").select(key, "first")
    return Once(one, kept(every, "every") if small else every)


def spread(found: DataFrame, queries: Once | None = None, rows: Once | None = None, staged: bool = True) -> DataFrame:
    """found: (perhaps query_id, row_id, ...) of what stands for others; the same of all queries, and of all rows.

    The rows are dealt evenly, whatever the number of their texts, as each may give a row to many queries.
    """
    out = kept(found, "found") if staged else found
    if rows is not None:
        tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = _keys(rows, "row_id").repartition(tasks, "_key").join(out, "row_id").drop("row_id").withColumnRenamed("_key", "row_id")
    if queries is not None:
        out = out.join(_keys(queries, "query_id"), "query_id").drop("query_id").withColumnRenamed("_key", "query_id")
    return out.select(*found.columns)


def _keys(own: Once, first: str) -> DataFrame:
    (key,) = [c for c in own.every.columns if c != "first"]
    return own.every.select(F.col(key).alias("_key"), F.col("first").alias(first))
