"""Operator 6, line dedup, with DataFrame functions only.

The index of lines is a set of levelled runs. A run is a table of (line hash, documents), sorted by hash. A batch of
documents is counted by hash, anti-joined with the keys that the runs have settled (those already in `min_docs`
documents: no more counting is needed), and what is left is added as a run of level 0. When a level has `fanout` runs,
they are compacted into one run of the next level. A key's documents are the sum over the runs.

Lines are joined with the settled keys; a document of more than FEW common lines has its lines looked up by a join, too.

A line's key is the line without ASCII white space at both ends, A-Z in lower case; its hash has 128 bits. Lines whose
key has a code point or more and is in `min_docs` documents or more leave every document; an empty key never goes.
A null or empty text is one empty line. Repeated rows count as documents of their own, null and equal ids alike. An
empty table gives an empty result. Further columns, whatever their names, pass through `deduplicated` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unfolded, unstage, whole, with_row_key

MIN_DOCS = 10
BATCHES, FANOUT = 4, 3
#: A document with more common lines has its lines joined with them.
FEW = 100
#: At most so many row keys are broadcast.
MOST_ROWS = 100_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(_SPACE))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"), (key != "").alias("full"))


def _distinct(sorted_array: Column) -> Column:
    """array_distinct of structs would take the square of a long document's lines."""
    return F.filter(sorted_array, lambda x, i: (i == 0) | (x != F.get(sorted_array, i - 1)))


def line_hashes(keyed: DataFrame) -> DataFrame:
    """(row_file, row_index, a, b): one row for each line key of a document."""
    sets = keyed.select("row_file", "row_index", F.sort_array(F.filter(F.transform(lines_of(F.col("text")), _hashes), lambda x: x["full"])).alias("all"))
    own = sets.select("row_file", "row_index", F.explode(_distinct(F.col("all"))).alias("x"))
    return own.select("row_file", "row_index", "x.a", "x.b")


class LineRuns:
    """Levelled sorted runs of (a, b, docs)."""

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("a", "b").agg(F.sum("docs").alias("docs"))

    def _store(self, counts: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(staged(counts.sortWithinPartitions("a", "b"), f"run{level}"))

    def settled(self) -> DataFrame | None:
        """The keys that are in min_docs documents or more."""
        runs = self.runs()
        return self._merged(runs).filter(F.col("docs") >= self.min_docs).select("a", "b") if runs else None

    def add(self, lines: DataFrame) -> None:
        """lines: a row for each key of each document of the batch."""
        counts = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))
        known = self.settled()
        self._store(counts.join(known, ["a", "b"], "left_anti") if known is not None else counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._store(self._merged(old), level + 1)
            self.levels[level] = []
            for run in old:
                unstage(run)
            level += 1


def kept_lines(keyed: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """keyed: (row_file, row_index, text) and perhaps more. All of it without the text, with n_lines and lines, those that stay."""
    texts = keyed.select("row_file", "row_index", "text")
    batch = F.pmod(F.xxhash64("row_file", "row_index"), F.lit(batches)).cast("int")
    lines = staged(line_hashes(texts).withColumn("batch", batch), "lines", partition_by="batch")
    index = LineRuns(min_docs, fanout)
    for k in range(batches):
        index.add(lines.filter(F.col("batch") == k))
    settled = staged(index.settled(), "settled")  # a scan on each side: the join broadcasts it if small, or splits its common keys
    hits = staged(lines.join(settled, ["a", "b"]).groupBy("row_file", "row_index").agg(F.collect_list("a").alias("gone")), "hits")
    hits = _with_wide(texts, hits)
    every = keyed.join(hits.hint("merge"), ["row_file", "row_index"], "left")  # hits grow with the texts
    every = every.withColumn("all", lines_of(F.col("text")))
    stays = lambda line: ~F.array_contains(F.col("gone"), F.xxhash64(line_key(line)))
    lines = F.when(F.col("own").isNotNull(), F.col("own.line")).when(F.col("gone").isNotNull(), F.filter("all", stays)).otherwise(F.col("all"))
    return every.withColumn("lines", lines).withColumn("n_lines", F.size("all").cast("long")).drop("text", "all", "gone", "own")


def _with_wide(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """hits with one more column, own: what stays of a document of many common lines, each line with its position.

    Such a document's lines are looked up by a join; an array of common lines would be read through for each line.
    """
    own, key = "array<struct<pos: int, line: string>>", ["row_file", "row_index"]
    wide = hits.filter(F.size("gone") > FEW)
    n = wide.count()
    if not n:
        return hits.withColumn("own", F.lit(None).cast(own))
    rows = wide.select(*key)
    lines = texts.join(F.broadcast(rows) if n <= MOST_ROWS else rows, key, "left_semi")
    lines = lines.select(*key, F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("a", F.xxhash64(line_key(F.col("line"))))
    stay = lines.join(wide.select(*key, F.explode("gone").alias("a")), [*key, "a"], "left_anti")
    stay = stay.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("own"))
    placed = wide.select(*key).join(stay, key, "left").select(*key, F.lit(None).cast("array<bigint>").alias("gone"), F.coalesce("own", F.array().cast(own)).alias("own"))
    return hits.filter(F.size("gone") <= FEW).withColumn("own", F.lit(None).cast(own)).unionByName(placed)


def line_dedup(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document."""
    kept = kept_lines(with_row_key(docs, "doc_id", "text"), **options)
    dropped = F.col("n_lines") - F.size("lines")
    return kept.select("doc_id", "n_lines", dropped.alias("n_dropped"), F.sha2(F.array_join("lines", "\n"), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, **options: int) -> DataFrame:
    """docs with what stays of each text; n_chars, if there, follows."""
    kept = kept_lines(with_row_key(docs, whole(docs, "text", "n_chars"), "text"), **options)
    text = F.array_join("lines", "\n")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unfolded(kept, docs, **changed)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key AS gone FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = gone GROUP BY rid, doc_id
"""
