"""Operator 12, periodic runs: seed and extend along the diagonals of a document's words against itself.

A run of period q and length L agrees with itself, q words on, over L - q words: at least max(12 - q, q), and so 6.

1. Index: the 6-grams of all words of some texts are hashed with their document and sorted; only those that occur twice in
   one document go on. For periods of 12 and more there are levels of k = 6, 12, 24, ...: the periods from 2k up to 4k
   guarantee an agreement of 2k words, which holds a k-gram whose place is a multiple of k. So a level compares at most
   n / k places with 2k others each.
2. Pairs: a seed meets the occurrences of its k-gram within the level's periods. Pairs within a run of a smaller period, at
   most k, are skipped: their periods are multiples of it. So one word repeated throughout makes no pairs at the levels.
3. Extension: of the seeds of a lag that follow each other without a gap only the first is extended, as the furthest word
   that it covers lies beyond the others. Ends are found by halving on sums of word hashes, and what is found is compared
   word by word before it counts. Of stretches with the same ends the one of the smallest period is the run.

Texts are worked on some at a time (`GROUP` bytes; a longer text by itself), and only their own words are in memory.

A null or empty text has no word and no run. Repeated rows are rows of their own; a null id counts as the empty text where
its hash is asked for. An empty table gives an empty result. Columns other than doc_id and text are passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare
from .hashing import mix

SHORTEST, SEED = 12, 6
GROUP = 1 << 20
#: Pairs that are in memory at a time.
PAIRS = 1 << 21


def agreement(period: np.ndarray) -> np.ndarray:
    """How many words a run of a period must share with itself, a period on."""
    return np.maximum(SHORTEST - period, period)


class Words:
    """The words of some texts in a row, a sentinel of its own after each text."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        codes: dict[bytes, int] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes
        self.w = np.empty(int(sizes.sum()) + len(texts), np.int64)
        for own, a, b in zip(texts, self.begin.tolist(), self.end.tolist(), strict=True):
            self.w[a:b] = np.fromiter((codes.setdefault(x, len(codes)) for x in own), np.int64, b - a)
        self.w[self.end] = -1 - np.arange(len(texts))
        self.text = np.repeat(np.arange(len(texts)), sizes + 1)
        self.sums: np.ndarray | None = None

    def _sums(self) -> np.ndarray:
        if self.sums is None:
            n, base = len(self.w), np.uint64(0x9E3779B97F4A7C15)
            step = np.full(n + 1, base)
            step[0] = 1
            self.power = np.cumprod(step)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(self.w.astype(np.uint64)) * self.power[:n], out=self.sums[1:])
        return self.sums

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """A hash of the k words from each place."""
        sums, inverse = self._sums(), pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        if not hasattr(self, "inverse"):
            step = np.full(len(self.w) + 1, np.uint64(inverse))
            step[0] = 1
            self.inverse = np.cumprod(step)
        return (sums[at + k] - sums[at]) * self.inverse[at]

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on and from j on have the same hash (i < j)."""
        sums = self._sums()
        return (sums[i + n] - sums[i]) * self.power[j - i] == sums[j + n] - sums[j]


def _occurring_twice(words: Words, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, place), by both, of the places whose k-gram occurs again in the same text."""
    at = at[at + k <= words.end[words.text[at]]]
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = words.hashes(at, k) + mix(words.text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    again = ~(new[:-1] & new[1:])
    gram = np.cumsum(new[:-1])
    return gram[again], at[again]


def _pairs(words: Words, gram: np.ndarray, at: np.ndarray, seeds: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of each seed, an index into at, with the places of its gram from low up to, not with, high; some millions at a time, by place."""
    n = np.int64(len(words.w) + 1)
    key = gram * n + at
    first = np.searchsorted(key, gram[seeds] * n + np.minimum(low, n - 1))
    many = np.maximum(np.searchsorted(key, gram[seeds] * n + np.minimum(high, n - 1)) - first, 0)
    ends = np.cumsum(many)
    cut = 0
    while cut < len(seeds) and ends[-1]:
        done = ends[cut] - many[cut]
        stop = max(cut + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        own = slice(cut, stop)
        place = np.repeat(at[seeds[own]], many[own])
        other = np.arange(len(place)) + np.repeat(first[own] - (ends[own] - done) + many[own], many[own])
        yield place, at[other] - place
        cut = stop


def _reach(words: Words, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from i and j on, or back from before them, `most` at most."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        a, b = (i[open_] - mid, j[open_] - mid) if back else (i[open_], j[open_])
        ok = words.same(a, b, mid)
        low[open_[ok]], high[open_[~ok]] = mid[ok], mid[~ok] - 1


def _extended(words: Words, place: np.ndarray, lag: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, lag) of what agrees around each pair and is long enough for a run."""
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    first = np.ones(len(place), bool)  # the one before it, of the same lag, reaches this one
    first[1:] = (lag[1:] != lag[:-1]) | (place[1:] - place[:-1] != step) | (words.text[place[1:]] != words.text[place[:-1]])
    place, lag = place[first], lag[first]
    text = words.text[place]
    ahead = _reach(words, place, place + lag, words.end[text] - place - lag, False)
    behind = _reach(words, place, place + lag, place - words.begin[text], True)
    enough = ahead + behind >= agreement(lag)
    place, lag, ahead, behind = place[enough], lag[enough], ahead[enough], behind[enough]
    for k, (p, q, a, b) in enumerate(zip(place.tolist(), lag.tolist(), ahead.tolist(), behind.tolist(), strict=True)):
        equal = words.w[p - b : p + a] == words.w[p - b + q : p + a + q]
        if not equal.all():  # two stretches with the same hash
            wrong = np.flatnonzero(~equal) - b
            ahead[k] = min([a, *wrong[wrong >= 0]])
            behind[k] = min([b, *(-1 - wrong[wrong < 0])])
    enough = ahead + behind >= agreement(lag)
    return ((place - behind)[enough], (ahead + behind + lag)[enough], lag[enough])


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) with the same start and length the one of the smallest period; by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _found(words: Words, gram: np.ndarray, at: np.ndarray, seeds: np.ndarray, low: np.ndarray, high: np.ndarray, step: int) -> np.ndarray:
    """The runs of one level's seeds, which go by place."""
    parts = [np.column_stack(_extended(words, place, lag, step)) for place, lag in _pairs(words, gram, at, seeds, low, high)]
    return _smallest(np.vstack([np.zeros((0, 3), np.int64), *parts]))


def runs(words: Words) -> np.ndarray:
    """Rows (start, length, period) of all runs, starts being places among all words."""
    gram, at = _occurring_twice(words, np.arange(len(words.w)), SEED)
    seeds = np.argsort(at)
    found = _found(words, gram, at, seeds, at[seeds] + 1, at[seeds] + 2 * SEED, 1)
    k = SEED
    while len(at):
        of = words.text[at]
        seeds = np.flatnonzero(((at - words.begin[of]) % k == 0) & (at + 3 * k <= words.end[of]))
        seeds = seeds[np.argsort(at[seeds])]
        own = at[seeds]
        low = own + 2 * k
        for start, length, _ in found[(found[:, 1] >= 3 * k) & (found[:, 2] <= k)].tolist():
            last = start + length - k  # the last k-gram within the run; two of these lie a multiple of its period apart
            a, b = np.searchsorted(own, [start, last + 1])
            low[a:b] = np.maximum(low[a:b], last + 1)
        found = _smallest(np.vstack([found, _found(words, gram, at, seeds, low, own + 4 * k, k)]))
        k *= 2
        gram, at = _occurring_twice(words, np.sort(at), k)
    return found


def periodic(texts: list[list[bytes]]) -> list[tuple[np.ndarray, list[bytes]]]:
    """Of each text its runs (start, length, period), by start and period, and the words that no run repeats."""
    words = Words(texts)
    found = runs(words)
    depth = np.zeros(len(words.w) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    gone = np.cumsum(depth) > 0
    cuts = np.searchsorted(found[:, 0], [*words.begin, len(words.w)])
    out = []
    for k, own in enumerate(texts):
        mine = found[cuts[k] : cuts[k + 1]] - np.array([words.begin[k], 0, 0])
        dropped = gone[words.begin[k] : words.end[k]]
        out.append((mine, [w for w, d in zip(own, dropped.tolist(), strict=True) if not d] if len(mine) else own))
    return out


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words as the contract has them: for a tenth of the ids the text's end repeats itself."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    own = words[a : a + p]
    return words[:a] + (own * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, plant: bool = True) -> DataFrame:
    """n_runs, the longest run and the digests of each document; plant: of its words as the contract edits them."""
    prepare(docs.sparkSession)
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]

    def made(ids: list, texts: list[bytes]) -> list[list]:
        split = [t.split() for t in texts]
        split = [planted(i, w) for i, w in zip(ids, split, strict=True)] if plant else split
        columns: list[list] = [[] for _ in range(7)]
        for mine, kept in periodic(split):
            best = (None,) * 4
            if len(mine):
                s, n, q = max(mine.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
                best = (s, n, q, 1000 * n // q)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in mine.tolist())
            row = (len(mine), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return columns

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            ids, at = batch.column("doc_id"), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
                    size += len(texts[end])
                    end += 1
                columns = made(ids[at:end].to_pylist(), texts[at:end])
                arrays = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([ids[at:end], *arrays], ["doc_id", *numbers, "runs_sha256", "collapsed_sha256"])
                at = end

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in numbers) + ", runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(found, schema)


ORACLE_SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
      xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h FROM documents, t),
p AS (SELECT rid, doc_id, ws, h % 10 = 0 AND len(ws) > 0 AS edited, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts FROM d),
e AS (SELECT rid, doc_id, CASE WHEN edited THEN list_transform(range(len(ws)), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(ws) - a) // parts) END]) ELSE ws END AS ws FROM p),
g AS (SELECT rid, i, array_to_string(ws[i + 1 : i + 6], ' ') AS gram FROM (SELECT rid, ws, unnest(range(len(ws) - 5)) AS i FROM e)),
pairs AS (SELECT x.rid, y.i - x.i AS q, x.i FROM g x JOIN g y ON x.rid = y.rid AND x.gram = y.gram AND y.i > x.i),
islands AS (SELECT rid, q, min(i) AS s, max(i) - min(i) + 6 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island),
r AS (SELECT rid, s, n + q AS n, min(q) AS q FROM islands WHERE n >= greatest(12 - q, q) GROUP BY rid, s, n + q),
f AS (SELECT rid, count(*) AS n_runs, first(struct_pack(s := s, n := n, q := q) ORDER BY n DESC, s, q) AS best, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY rid),
w AS (SELECT rid, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM e),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = w.rid AND i >= s + q AND i < s + n) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN f USING (rid) LEFT JOIN k USING (rid)
"""
