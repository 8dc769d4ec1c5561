"""Operator 11, source divergence audit, by Arrow's compute functions on partial counts and columnar shards.

1. `partial_counts`: within `mapInArrow` texts are lower-cased (`ascii_lower`), split into terms (`split_pattern_regex`),
   dictionary-encoded and counted by a hash `group_by`: a row for each (language, source, term) of some batches, with its
   occurrences and documents. A row without a term (the empty text) says that a source occurs at all.
2. The partial counts of a term meet by (language, term), a key that holds a row for each source and task at most. A
   language keeps the terms of enough documents; a row holds a term's counts in all sources of its language.
3. Languages are cut into shards of about CELLS counts, by the hash of the term, so that none grows with a hot language; each
   shard gets the totals of its language's sources. It computes shares and divergences of its terms in 64-bit integers, adds
   them up for each pair of sources and keeps its own highest terms of each source. Sums and ranks over shards follow.

A share is 1 + floor(scale * (count + 1) / (total + terms)), by long division in three steps, so that no product overflows
while a language has fewer than 9e15 occurrences. Its squares are below 2^63 as shares are at most 1 + scale.

Null text, language and source are empty texts; an empty text is a language or source like any other. Repeated rows count as
documents of their own. Ties go by the bytes of the item. A language that keeps no term has pairs of value 0. An empty table
gives an empty result. Other columns, whatever their names, are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, staged

MIN_DOCS, SCALE, TOP = 3, 10**9, 200
#: Counts of a shard, about; partial counts that a task gathers before it passes them on; cells of a block of shares.
CELLS, PENDING, BLOCK = 40_000, 1_000_000, 1 << 20
#: What lies between terms (fixed value).
_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_KEYS = ["lang", "source", "term"]


def counted(texts: pa.Array, groups: pa.Array) -> pa.Table:
    """(group, term, count, docs) of the terms of texts, each of the group in its place."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), _GAP)
    rows, terms = pc.list_parent_indices(lists), pc.list_flatten(lists).dictionary_encode()
    full = pc.not_equal(terms.dictionary, "")
    table = pa.table({"row": rows, "code": terms.indices}).filter(pc.take(full, terms.indices))
    once = table.group_by(["row", "code"]).aggregate([([], "count_all")])  # a row for each term of a document
    once = once.append_column("group", pc.take(groups, once.column("row")))
    own = once.group_by(["group", "code"]).aggregate([("count_all", "sum"), ([], "count_all")])
    return pa.table({"group": own.column("group"), "term": pc.take(terms.dictionary, own.column("code")), "count": own.column("count_all_sum").cast(pa.int64()), "docs": own.column("count_all")})


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs), several rows of a key."""
    prepare(docs.sparkSession)

    def merged(parts: list[pa.Table]) -> pa.Table:
        own = pa.concat_tables(parts).group_by(_KEYS).aggregate([("count", "sum"), ("docs", "sum")])
        return own.rename_columns([*_KEYS, "count", "docs"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, pending = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = pa.array(np.arange(batch.num_rows))
            heads = pa.table({"lang": batch.column("lang").fill_null(""), "source": batch.column("source").fill_null(""), "place": place})
            groups = heads.group_by(["lang", "source"]).aggregate([("place", "min"), ([], "count_all")])
            groups = groups.append_column("group", pa.array(np.arange(groups.num_rows)))
            heads = heads.join(groups.select(["lang", "source", "group"]), ["lang", "source"]).sort_by("place")
            own = counted(batch.column("text").fill_null(""), heads.column("group").combine_chunks())
            n = groups.num_rows
            parts.append(pa.table({"lang": groups.column("lang"), "source": groups.column("source"), "term": pa.array([""] * n), "count": pa.array([0] * n, pa.int64()), "docs": groups.column("count_all")}))
            parts.append(pa.table({"lang": pc.take(groups.column("lang"), own.column("group")), "source": pc.take(groups.column("source"), own.column("group")), "term": own.column("term"), "count": own.column("count"), "docs": own.column("docs")}))
            pending += own.num_rows
            if pending >= PENDING:
                parts = [merged(parts)]
                pending = parts[0].num_rows
                if pending >= PENDING // 2:
                    yield from parts[0].to_batches(max_chunksize=65_536)
                    parts, pending = [], 0
        if parts:
            yield from merged(parts).to_batches(max_chunksize=65_536)

    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return own.mapInArrow(counts, "lang string, source string, term string, count bigint, docs bigint")


def kept_terms(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Staged (lang, term, total, sources, counts) of the terms that stay, and (lang, source) of all groups."""
    summed = partial_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = summed.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("own"))
    terms = staged(terms.select("lang", "term", "total", "docs", F.col("own.source").alias("sources"), F.col("own.count").alias("counts")), "terms")
    groups = terms.filter("term = ''").select("lang", F.explode("sources").alias("source"))
    return terms.filter(f"term <> '' AND docs >= {min_docs}"), groups


def _shares(counts: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / bases), digit by digit to the base of 1000."""
    rest, share = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, bases.shape), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, bases)
        share = share * 1000 + digit
    return share + 1


def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _byte_order(words: pa.Array) -> np.ndarray:
    """The place of each word among all by their UTF-8 bytes."""
    order = pc.sort_indices(words.cast(pa.large_binary())).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: `pair` of each other source of the language, `term` of a source's own terms."""
    terms, groups = kept_terms(docs, min_docs)
    totals = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.ceil(F.sum(F.size("counts")) / CELLS).alias("shards"))
    groups = groups.join(sizes, "lang", "left").select("lang", "source", "total", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("shards", F.lit(1)).alias("shards"))
    groups = staged(groups, "groups")
    langs = groups.groupBy("lang").agg(F.first("shards").alias("shards"))
    shard = F.pmod(F.xxhash64("term"), F.col("shards"))
    left = terms.join(langs, "lang").select("lang", shard.alias("shard"), "term", "total", "sources", "counts")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", "total", "terms")

    def shares(left: pa.Table, right: pa.Table) -> pa.Table:
        names, n = right.column("source").to_pylist(), right.num_rows
        place = {s: k for k, s in enumerate(names)}
        bases = right.column("total").to_numpy() + right.column("terms").to_numpy()  # each has terms or the shard has none
        whole = np.int64(right.column("total").to_numpy().sum() + (right.column("terms")[0].as_py() if n else 0))
        lists = left.column("counts").combine_chunks()
        cells = lists.flatten().to_numpy()
        source = np.array([place[s] for s in left.column("sources").combine_chunks().flatten().to_pylist()], np.int64)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        total, sums, best = left.column("total").to_numpy(), np.zeros((n, n), np.int64), []
        step = max(1, BLOCK // max(n, 1))
        for at in range(0, left.num_rows, step):
            stop = min(at + step, left.num_rows)
            row = np.repeat(np.arange(stop - at), np.diff(ends[at : stop + 1]))
            own = slice(ends[at], ends[stop])
            counts = np.zeros((stop - at, n), np.int64)
            counts[row, source[own]] = cells[own]
            p = _shares(counts, bases)
            for k in range(n):
                sums[k] += _squares(p[:, k : k + 1], p).sum(0)
            q = _shares(total[at:stop], whole)
            here = p[row, source[own]]
            value = _squares(here, q[row])
            over = (cells[own] > 0) & (here > q[row])
            best.append(np.column_stack([source[own][over], row[over] + at, value[over]]))
        here, other = np.nonzero(~np.eye(n, dtype=bool))
        label = pa.array(names, pa.string())
        pairs = {"source": label.take(pa.array(here)), "part": pa.array(["pair"] * len(here), pa.string()), "item": label.take(pa.array(other)), "value": pa.array(sums[here, other])}
        found = np.vstack([np.zeros((0, 3), np.int64), *best])
        words = left.column("term").combine_chunks()
        found = found[np.lexsort((_byte_order(words)[found[:, 1]], -found[:, 2], found[:, 0]))]
        nth = np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0])
        found = found[nth < top]
        own_terms = {"source": label.take(pa.array(found[:, 0])), "part": pa.array(["term"] * len(found), pa.string()), "item": words.take(pa.array(found[:, 1])), "value": pa.array(found[:, 2])}
        table = pa.concat_tables([pa.table(pairs), pa.table(own_terms)])
        lang = right.column("lang")[0].as_py() if n else ""
        return table.add_column(0, "lang", pa.array([lang] * table.num_rows, pa.string()))

    parts = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(shares, "lang string, source string, part string, item string, value bigint")
    parts = staged(parts, "parts")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = parts.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)  # cut within tasks before the exchange
    return pairs.withColumn("rank", rank).unionByName(best)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS terms, sum(total) AS whole FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT s.lang, source, term, n, 1 + CAST({SCALE} AS HUGEINT) * (n + 1) // (own + terms) AS p, 1 + CAST({SCALE} AS HUGEINT) * (total + 1) // (whole + terms) AS q FROM s JOIN v ON s.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
