"""Two versions of texts line by line (U5s, G4): removed, added and kept lines of a longest common subsequence, and hunks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Beyond so many cells what differs is all removed and then all added (fixed value).
CELLS = 4_000_000


def lines_of(text: Column) -> Column:
    """The lines of a text; an end of line at its end begins no other."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"))


def _kept_pairs(old: np.ndarray, new: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of equal lines that stay, of numbered lines; where two ways are as long, removals come first.

    A row of the table of lengths follows from the row below by one running maximum; of each cell two bits say where to go on.
    """
    n, m = len(old), len(new)
    if n * m > CELLS:
        return []
    below, down = np.zeros(m + 1, np.int32), np.zeros((n, m), bool)
    for i in range(n - 1, -1, -1):
        best = below.copy()
        same = new == old[i]
        best[:-1][same] = np.maximum(best[:-1], below[1:] + 1)[same]
        row = np.maximum.accumulate(best[::-1])[::-1]
        down[i] = below[:-1] >= row[1:]
        below = row
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if old[i] == new[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif down[i, j]:
            i += 1
        else:
            j += 1
    return pairs


def _steps(old: list[str], new: list[str]) -> list[tuple[str, str, int | None, int | None]]:
    """(op, text, line of the old one, line of the new one), counted from 1."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in lines], np.int64) for lines in (old, new))
    most = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:most] == b[:most], False)))
    rest = most - head
    tail = int(np.argmin(np.append(a[::-1][:rest] == b[::-1][:rest], False)))
    middle = _kept_pairs(a[head : len(a) - tail], b[head : len(b) - tail])
    pairs = [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in middle] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        out += [("del", old[k], k + 1, None) for k in range(i, x)] + [("add", new[k], None, k + 1) for k in range(j, y)]
        if x < len(a):
            out.append(("same", old[x], x + 1, y + 1))
        i, j = x + 1, y + 1
    return out


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tab, step, op, text, a, b) for every line of either version. old, new: (tab, text); a tab that one lacks is empty there.

    A tab is worked on by itself, as its lines depend on each other; tabs are spread over the tasks.
    """
    both = old.select("tab", F.col("text").alias("was")).join(new.select("tab", F.col("text").alias("now")), "tab", "full")
    own = both.select("tab", lines_of(F.col("was")).alias("old"), lines_of(F.col("now")).alias("new"))

    def diffs(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                steps = _steps(batch.column("old")[k].as_py(), batch.column("new")[k].as_py())
                op, text, a, b = zip(*steps, strict=True) if steps else ((), (), (), ())
                columns = [batch.column("tab").take(pa.array([k] * len(steps), pa.int64())), pa.array(range(len(steps)), pa.int32()), pa.array(op, pa.string()), pa.array(text, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["tab", "step", "op", "text", "a", "b"])

    return own.mapInArrow(diffs, f"tab {old.schema['tab'].dataType.simpleString()}, step int, op string, text string, a int, b int")


def hunks(steps: DataFrame, context: int = 2) -> DataFrame:
    """The changed lines and `context` lines around them, numbered from 0 within a tab: gaps between changes as islands."""
    at = W.partitionBy("tab").orderBy("step")
    changed = F.when(F.col("op") != "same", F.col("step"))
    near = steps.withColumn("before", F.last(changed, ignorenulls=True).over(at)).withColumn("after", F.first(changed, ignorenulls=True).over(at.rowsBetween(0, W.unboundedFollowing)))
    own = near.filter((F.col("step") - F.col("before") <= context) | (F.col("after") - F.col("step") <= context))
    starts = F.when(F.col("step") - F.lag("step").over(at) == 1, 0).otherwise(1)
    return own.withColumn("starts", starts).withColumn("hunk", (F.sum("starts").over(at) - 1).cast("int")).select("tab", "hunk", "step", "op", "text", "a", "b")
