"""Operator 5, document fingerprints: one-permutation MinHash with optimal densification, kept as low-order bits.

Each five-word shingle is hashed once. The hash's top bits choose a bin, the rest is its value there; a bin keeps its least
value. An empty bin copies the bin that a fixed random sequence of its own leads to first among those that were filled, alike
for every document, so that two documents' bins stay comparable. Of each bin's value only `BITS` low-order bits are kept;
two unlike values agree in them once in 2**BITS, which the likeness corrects for.

Texts of fewer words than five are one shingle of what they have; null and empty texts are one shingle of nothing, alike
only to one another. Equal texts have equal fingerprints. Repeated rows, equal ids and null ids (first in order) each
stay a row; rows of equal id are ordered by text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import prepare

BINS, BITS = 256, 4
#: Steps of a bin's own random sequence; what is still empty then takes the next filled bin around the circle.
STEPS = 512
#: Ids that are sampled for each range.
SAMPLED = 50
#: Rows that are compared at a time.
ROWS = 1024
_SEQUENCE = np.random.default_rng(5).integers(0, BINS, (STEPS, BINS))


def minima(texts: pa.Array) -> np.ndarray:
    """The densified bins of each text."""
    data, offsets = hashing.buffers(texts)
    out = np.empty((len(texts), BINS), np.uint64)
    for a, b in hashing.groups(offsets):
        text, h = hashing.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for first in range(0, b - a, 4096):  # twelve bits for the text in each sorted key
            lo, hi = np.searchsorted(text, (first, first + 4096))
            key = np.sort((text[lo:hi] - first).astype(np.uint64) << np.uint64(52) | h[lo:hi] >> np.uint64(12))
            slot = key >> np.uint64(44)
            new = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
            n = min(4096, b - a - first)
            bins = np.zeros(n * BINS, np.uint64)
            filled = np.zeros(n * BINS, bool)
            bins[slot[new]], filled[slot[new]] = key[new] & np.uint64((1 << 44) - 1), True
            out[a + first : a + first + n] = densified(bins.reshape(n, BINS), filled.reshape(n, BINS))
    return out


def densified(bins: np.ndarray, filled: np.ndarray) -> np.ndarray:
    row, bin_ = np.nonzero(~filled)
    out = bins.copy()
    for step in range(STEPS):
        if not len(row):
            return out
        source = _SEQUENCE[step][bin_]
        found = filled[row, source]
        out[row[found], bin_[found]] = bins[row[found], source[found]]
        row, bin_ = row[~found], bin_[~found]
    for r, i in zip(row.tolist(), bin_.tolist(), strict=True):
        around = np.flatnonzero(np.roll(filled[r], -i))
        out[r, i] = bins[r, (i + around[0]) % BINS]
    return out


def packed(bins: np.ndarray) -> np.ndarray:
    """The low-order bits of each row's bins, two bins a byte."""
    low = (hashing.mix(bins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimate of the Jaccard index from packed rows, corrected for chance agreement; 0 to 1."""
    differ = a ^ b
    equal = ((differ & 0xF0) == 0).sum(axis=1) + ((differ & 0x0F) == 0).sum(axis=1)
    chance = 1 / (1 << BITS)
    return np.clip((equal / BINS - chance) / (1 - chance), 0, 1)


def fingerprint(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with one more column, fingerprint: packed bits as binary."""
    prepare(docs.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = packed(minima(batch.column(column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())], [*batch.schema.names, "fingerprint"])

    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["fingerprint binary"])
    return docs.mapInArrow(add, schema)


def _cuts(ids: DataFrame, n: int) -> list:
    """Up to n - 1 ids that cut the table into ranges of about the same size: quantiles of a sample of some SAMPLED ids a range."""
    rows = ids.count()
    if n < 2 or not rows:
        return []
    found = sorted(r.doc_id for r in ids.filter(F.col("doc_id").isNotNull() & (F.rand(5) < min(1.0, SAMPLED * n / rows))).collect())
    return sorted({found[k * len(found) // n] for k in range(1, n)}) if found else []


def neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, p, guest): rows in order of id, each range followed by the row after it; after the last comes the first.

    Ids of any type that has an order are dealt into ranges, a task each; the first document of each range is also sent, as a
    guest, to the range before it. So no task sees more than its range and one row. Only the sampled ids and the ranges'
    first ids reach the driver; where the ranges are cut doesn't change the result.
    """
    ids = docs.select("doc_id")
    n = ranges or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = _cuts(ids, n)
    edges = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(f"array<{kind}>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]) if cuts else F.array().cast("array<int>")
    # how many edges are not above the id, by halving
    of = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    firsts = {r.p: r.first for r in ids.select(of.alias("p"), "doc_id").groupBy("p").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("first")).collect()}
    if not firsts:
        return docs.select("doc_id", "text", F.lit(0).alias("p"), F.lit(0).alias("guest"))
    parts = sorted(firsts)
    back = {p: parts[k - 1] for k, p in enumerate(parts)}  # the first's goes to the last
    row = lambda p: F.struct(F.lit(firsts[p].id if p in firsts else None).cast(kind).alias("id"), F.lit(back.get(p)).cast("int").alias("to"))
    first_of = F.array(*[row(p) for p in range(parts[-1] + 1)])
    dealt = docs.select("doc_id", "text", of.alias("p"))
    own = dealt.withColumn("guest", F.lit(0))
    guests = (
        dealt.withColumn("g", F.get(first_of, F.col("p")))
        .filter(F.col("g.to").isNotNull() & F.col("g.id").eqNullSafe(F.col("doc_id")))
        .groupBy("p", "doc_id", F.col("g.to").alias("to"))
        .agg(F.min(F.struct(F.col("text").isNotNull(), F.col("text"))).alias("least"))
        .select("doc_id", F.col("least.text").alias("text"), F.col("to").alias("p"), F.lit(1).alias("guest"))
    )
    both = own.unionByName(guests).repartitionById(max(parts[-1] + 1, 1), "p")
    return both.sortWithinPartitions("p", "guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def op_schema(docs: DataFrame) -> str:
    kind = dict(docs.dtypes)["doc_id"]
    return f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, and its likeness to an edited form of itself and to the next document."""
    prepare(docs.sparkSession)
    schema = op_schema(docs)

    def rows(ids: list, texts: list[str], ends: list[str]) -> pa.RecordBatch:
        n = len(ids)
        edited = [t[: len(t) - len(t) // 2] + e[: len(t) // 2] for t, e in zip(texts, ends, strict=True)]
        bits = packed(minima(pa.array([*texts, *edited, ends[-1]], pa.large_string())))
        own, changed = bits[:n], bits[n : 2 * n]
        following = np.concatenate([own[1:], bits[2 * n :]])
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": ids,
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": [r.tobytes().hex() for r in own],
                "edited_fingerprint": [r.tobytes().hex() for r in changed],
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, following),
            }
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range, each range's own in order and then its guest; a row waits for the one after it."""
        waiting: tuple | None = None
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            some = [(i, "" if t is None else t, p, g) for i, t, p, g in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "p", "guest")), strict=True)]
            run = ([waiting] if waiting else []) + some
            waiting = run[-1] if run and not run[-1][3] else None
            ids, texts, ends = [], [], []
            for a, b in zip(run, run[1:], strict=False):
                if a[3]:
                    if ids:
                        yield rows(ids, texts, ends)
                    ids, texts, ends = [], [], []
                    continue
                ids.append(a[0])
                texts.append(a[1])
                ends.append(b[1])
            if ids:
                yield rows(ids, texts, ends)

    return neighbours(docs.select("doc_id", "text"), ranges).mapInArrow(walk, schema)
