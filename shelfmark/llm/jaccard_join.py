"""Operator 8, n-gram Jaccard join: candidates from MinHash bands, Bayesian pruning, exact verification.

Documents of equal shingle sets are one class from the start. Each set has HASHES MinHash values; sets that agree in all
values of a band are candidates (at a Jaccard index of exactly 0.8 a pair is missed with probability 5e-5, above it less).
Candidate sets are gathered into clusters, the components of the graph of shared bands. A cluster is compared in blocks of
BLOCK sets: a task sees two blocks, so no group of any size meets in one task, and none is expanded into pairs of rows.
Within a task, the MinHash values of each candidate pair are compared 16 at a time; with a uniform prior the index has
a Beta posterior, and a pair is dropped once the probability that it reaches the threshold is below TOLERANCE. For
all others the sets themselves are intersected. Links leave a task as counts for each set, and as a spanning forest.

Shingles are runs of five words (a shorter text is one shingle of its words; null, empty and blank texts all are the same
shingle of nothing, and so copies of one another). Repeated rows and equal or null ids are documents of their own. An
empty table gives no rows. Further columns are ignored, or kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import plain, prepare, staged, unfolded, whole, with_row_key
from .components import components

THRESHOLD, SHINGLE = 0.8, 5
HASHES, BAND = 128, 5
BANDS = HASHES // BAND
STEP, TOLERANCE = 16, 1e-6
BLOCK = 512
_A = np.random.default_rng(8).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(9).integers(0, 1 << 63, HASHES, np.uint64)


def minimum_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches below which the posterior probability of the threshold is under the tolerance)."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        least = 0
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                break
            least = m + 1
        out.append((n, least))
    return out


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first text, its and the following texts' sorted sets, their signatures) of groups of texts."""
    data, offsets = hashing.buffers(texts)
    for a, b in hashing.groups(offsets):
        which, h = hashing.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE)
        at = np.searchsorted(which, np.arange(b - a + 1))
        signature = np.empty((b - a, HASHES), np.uint32)
        for i in range(HASHES):
            signature[:, i] = np.minimum.reduceat(h * _A[i] + _B[i], at[:-1]) >> np.uint64(32)
        yield a, [np.unique(h[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], signature


def band_keys(signature: np.ndarray) -> np.ndarray:
    part = signature[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
    joined = np.repeat(np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15), len(part), 0)
    for i in range(BAND):
        joined = hashing.mix(joined + part[:, :, i])
    return joined.view(np.int64)


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    return int(own.sum(dtype=np.uint64).view(np.int64)), int(hashing.mix(own ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def sketches(keyed: DataFrame) -> DataFrame:
    """Staged (row_file, row_index, doc_id, a, b, bands): the set's key and band keys of each document."""
    prepare(keyed.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands = [], []
            for _, sets, signature in shingle_sets(batch.column("text")):
                keys += map(set_key, sets)
                bands.append(band_keys(signature))
            flat = np.concatenate([*bands, np.zeros((0, BANDS), np.int64)]).ravel()
            bands_of = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_file"), batch.column("row_index"), batch.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), bands_of],
                ["row_file", "row_index", "doc_id", "a", "b", "bands"],
            )

    kind = dict(keyed.dtypes)["doc_id"]
    return staged(keyed.select("row_file", "row_index", "doc_id", "text").mapInArrow(sketch, f"row_file bigint, row_index bigint, doc_id {kind}, a bigint, b bigint, bands array<bigint>"), "sketches")


def clusters(sets: DataFrame) -> DataFrame:
    """(a, b, root) of the sets that share a band with another; sets: (a, b, bands)."""
    members = sets.select("a", "b", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("a").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = staged(members.join(shared, "band").select("a", "b", "least").distinct(), "stars")
    roots = components(stars.select(F.col("a").alias("u"), F.col("least").alias("v")))  # two keys of equal a only share a cluster
    found = stars.select("a", "b").distinct().join(roots, F.col("a") == F.col("node"), "left")
    return staged(found.select("a", "b", F.coalesce("root", "a").alias("root")), "clusters")


def comparisons(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, g, i, j, side): which sets meet in which task. Small clusters share a task; large ones meet block by block."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    packs = max(1, ceil(members.count() / block))
    sized = members.join(sizes, "root")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("a", "b"), n_blocks.cast("bigint")).cast("int")
    alone = F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(packs)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side")))
    with_others = F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda k: F.struct(F.col("root").alias("g"), F.least(k, own).alias("i"), F.greatest(k, own).alias("j"), (own > k).cast("int").alias("side")),
    )
    meets = F.when(F.col("n") <= block, alone).otherwise(with_others)
    return sized.select("a", "b", F.explode(meets).alias("x")).select("a", "b", "x.*")


def _linked(frame: pd.DataFrame, least: list[tuple[int, int]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows that reach the threshold."""
    sets = [np.frombuffer(x, np.uint64) for x in frame["own"]]
    signature = np.stack([np.frombuffer(x, np.uint32) for x in frame["signature"]])
    bands, size, side = band_keys(signature), np.array([len(s) for s in sets]), frame["side"].to_numpy()
    n = len(sets)
    candidate = np.zeros((n, n), bool)
    for k in range(BANDS):
        candidate |= bands[:, k][:, None] == bands[:, k][None]
    i, j = frame["i"].iloc[0], frame["j"].iloc[0]
    candidate &= (side[:, None] < side[None]) if i < j else np.triu(np.ones((n, n), bool), 1)
    p, q = np.nonzero(candidate)
    matches, before = np.zeros(len(p), np.int64), 0
    for upto, fewest in least:
        matches += (signature[p, before:upto] == signature[q, before:upto]).sum(axis=1)
        stays, before = matches >= fewest, upto
        p, q, matches = p[stays], q[stays], matches[stays]
    if not len(p):
        return p, q
    rows = np.unique(np.concatenate([p, q]))
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    owner = np.repeat(np.arange(len(rows)), size[rows])
    _, column, count = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    often = count[column] > 1  # the others are in no intersection
    owner, column = owner[often], (np.cumsum(count > 1) - 1)[column[often]]
    columns, common = int((count > 1).sum()), np.zeros((len(rows), len(rows)), np.float64)
    width = max(1, (16 << 20) // len(rows))
    for first in range(0, columns, width):
        inside = (column >= first) & (column < first + width)
        has = np.zeros((len(rows), min(width, columns - first)), np.float32)
        has[owner[inside], column[inside] - first] = 1
        common += has @ has.T
    both = common[place[p], place[q]]
    near = both >= threshold * (size[p] + size[q] - both) - 1e-9
    return p[near], q[near]


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least row that each row is linked with, directly or by way of others."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(keyed: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """keyed: documents with row keys. A row for each document: row_file, row_index, doc_id, class_id, n_links and first, whether it comes first in its class.

    n_links: the other documents whose Jaccard index with it reaches the threshold. class_id: the least id among all that
    are linked with it, directly or by way of others.
    """
    prepare(keyed.sparkSession)
    sketched = sketches(keyed)
    head = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_file", "row_index")
    sets = staged(sketched.groupBy("a", "b").agg(F.min(head).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "sets")
    members = clusters(sets)
    wanted = members.join(sets, ["a", "b"]).select("a", "b", "copies", "head.row_file", "head.row_index")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, signatures = [], []
            for _, found, signature in shingle_sets(batch.column("text")):
                own += [s.tobytes() for s in found]
                signatures += [s.tobytes() for s in signature]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "copies")), pa.array(own, pa.binary()), pa.array(signatures, pa.binary())], ["a", "b", "copies", "own", "signature"])

    texts = keyed.join(wanted, ["row_file", "row_index"]).select("a", "b", "copies", "text")
    shown = staged(texts.mapInArrow(features, "a bigint, b bigint, copies bigint, own binary, signature binary"), "features")
    least = minimum_matches(threshold, TOLERANCE)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "b"], ignore_index=True)  # so that a forest's roots are its least sets
        p, q = _linked(frame, least, threshold)
        copies, n = frame["copies"].to_numpy(), len(frame)
        links = np.bincount(p, copies[q], n) + np.bincount(q, copies[p], n)
        root, some = _forest(n, p, q), np.flatnonzero(links)
        a, b = frame["a"].to_numpy(), frame["b"].to_numpy()
        whole = np.full(len(some), frame["i"].iloc[0] < 0)
        return pd.DataFrame({"whole": whole, "a": a[some], "b": b[some], "links": links[some].astype(np.int64), "root_a": a[root[some]], "root_b": b[root[some]]})

    met = comparisons(members, block).join(shown, ["a", "b"])
    linked = staged(met.groupBy("g", "i", "j").applyInPandas(compare, "whole boolean, a bigint, b bigint, links bigint, root_a bigint, root_b bigint"), "links")
    per_set = linked.groupBy("a", "b").agg(F.sum("links").alias("links"))
    root = F.struct(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    roots = linked.filter("whole").select("a", "b", root.alias("root"))  # these clusters were seen whole
    parts = linked.filter("not whole").select(F.struct("a", "b").alias("u"), root.alias("v"))
    if not parts.isEmpty():
        roots = roots.unionByName(components(parts).select("node.a", "node.b", "root"))
    placed = sets.drop("bands").join(per_set, ["a", "b"], "left").join(roots, ["a", "b"], "left")
    placed = placed.withColumn("root", F.coalesce("root", F.struct("a", "b")))
    heads = placed.groupBy("root").agg(F.min("head").alias("class_head"))
    known = placed.join(heads, "root").select("a", "b", "class_head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    first = (F.col("class_head.row_file") == F.col("row_file")) & (F.col("class_head.row_index") == F.col("row_index"))
    return sketched.join(known, ["a", "b"]).select("row_file", "row_index", "doc_id", F.col("class_head.doc_id").alias("class_id"), "n_links", first.alias("first"))


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id and n_links of each document."""
    return compared(with_row_key(docs, "doc_id", "text"), **options).select("doc_id", "class_id", "n_links")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that come first in their class: the least id, or of equal ids the first row."""
    docs = plain(docs)
    gone = compared(with_row_key(docs, "doc_id", "text"), **options).filter(~F.col("first")).select("row_file", "row_index")
    return unfolded(with_row_key(docs, whole(docs)).join(gone, ["row_file", "row_index"], "left_anti"), docs)
