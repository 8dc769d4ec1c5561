"""What is wrong with a list, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def problems(rows: DataFrame, wanted_tabs: DataFrame, school_code: str = "UAS") -> DataFrame:
    """(tab, problem, rows): wanted tabs that are missing or empty, the same row twice, and no row with the school's code.

    rows: (tab, row, fingerprint, codes); wanted_tabs: (tab).
    """
    per_tab = rows.groupBy("tab").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("codes", school_code)).alias("own"))
    missing = wanted_tabs.join(per_tab, "tab", "left_anti").select("tab", F.lit("missing").alias("problem"), F.lit(0).cast("bigint").alias("rows"))
    uncoded = per_tab.filter("own = 0").select("tab", F.lit("noSchoolCode").alias("problem"), F.col("n").alias("rows"))
    twice = rows.groupBy("tab", "fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("tab").agg(F.sum("n").alias("rows"))
    return missing.unionByName(uncoded).unionByName(twice.select("tab", F.lit("repeatedRow").alias("problem"), "rows"))


def unknown_tabs(asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Asked-for tabs, each once, that are not on the allow-list."""
    return asked.select("gid").distinct().join(allowed, "gid", "left_anti")
