"""Two versions of a list: which rows stayed, moved, came or went."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tab, fingerprint, nth, old_row, new_row): the k-th old row of a fingerprint with the k-th new one; what has no partner has null."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select("tab", "fingerprint", F.col("row").alias(name), F.row_number().over(W.partitionBy("tab", "fingerprint").orderBy("row")).alias("nth"))

    return numbered(old, "old_row").join(numbered(new, "new_row"), ["tab", "fingerprint", "nth"], "full").select("tab", "fingerprint", "nth", "old_row", "new_row")


def _nearest(old: list[int], new: list[int]) -> list[int | None]:
    """For each old row, in order, the nearest new row that none before it took, the upper one of two; rows rise.

    Taken rows are skipped by links to the next free one on either side, which shorten as they are followed.
    """
    n = len(new)
    lower, upper = list(range(n + 1)), list(range(n + 1))  # lower[k]: free places below k end here; upper[k]: the first free place from k on

    def follow(links: list[int], k: int) -> int:
        while links[k] != k:
            links[k] = links[links[k]]
            k = links[k]
        return k

    out: list[int | None] = []
    for row in old:
        k = bisect_left(new, row)
        right, left = follow(upper, k), follow(lower, k) - 1
        if right == n and left < 0:
            out.append(None)
            continue
        take = left if right == n or (left >= 0 and row - new[left] <= new[right] - row) else right
        out.append(new[take])
        upper[take], lower[take + 1] = take + 1, take
    return out


def paired_nearest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tab, fingerprint, old_row, new_row): copies pair up in order where both versions have as many, otherwise each old row, from the
    top, takes the nearest new row not yet taken; what has no partner has null.

    Only groups whose counts differ are gathered, as row numbers alone; the copies of one row in one tab are what a group holds.
    """
    key = ["tab", "fingerprint"]
    sizes = [df.groupBy(*key).agg(F.count(F.lit(1)).alias(name)) for df, name in ((old, "n_old"), (new, "n_new"))]
    uneven = sizes[0].join(sizes[1], key).filter("n_old <> n_new").select(*key)
    even = paired(old.join(uneven, key, "left_anti"), new.join(uneven, key, "left_anti")).drop("nth")

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        was, now = (sorted(t.column("row").to_pylist()) for t in (left, right))
        taken = _nearest(was, now)
        free = sorted(set(now) - set(taken))
        n = len(was) + len(free)
        keys = {k: pa.array([left.column(k)[0].as_py()] * n, left.schema.field(k).type) for k in key}
        return pa.table(keys | {"old_row": pa.array(was + [None] * len(free), left.schema.field("row").type), "new_row": pa.array(taken + free, left.schema.field("row").type)})

    of = old.schema
    schema = f"tab {of['tab'].dataType.simpleString()}, fingerprint {of['fingerprint'].dataType.simpleString()}, old_row {of['row'].dataType.simpleString()}, new_row {of['row'].dataType.simpleString()}"
    some = [df.join(uneven, key, "left_semi").select(*key, "row").groupBy(*key) for df in (old, new)]
    return even.unionByName(some[0].cogroup(some[1]).applyInArrow(matched, schema))


def signature(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(tab, rows, signature): alike for two versions of a tab with the same rows in any order."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = lambda k: F.conv(F.substring(F.md5(text), 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("tab").agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", F.sum(part(0)), F.sum(part(1))).alias("signature"))


def changed_tabs(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    a, b = signature(old, columns), signature(new, columns)
    both = a.select("tab", F.col("signature").alias("was"), F.col("rows").alias("n")).join(b, "tab", "full")
    return both.filter(~(F.col("was").eqNullSafe(F.col("signature")) & F.col("n").eqNullSafe(F.col("rows")))).select("tab")
