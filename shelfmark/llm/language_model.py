"""Operator 4, LM scoring: a gated recurrent language model beside a unigram base.

Tokens are runs of bytes other than ASCII white space, A-Z in lower case, and one end for each text. Counts cover every
training text and stay in a staged table. The tokens seen LEAST_COUNT times, and in any case the VOCABULARY most frequent, are
the model's own words, MOST_WORDS at most; all others are one word of the model, which shares its probability among them as the base does, so that the model is a distribution over
all tokens. The output softmax is factored: first a class of words, then the word within its class.

Training: gradients in numpy, backpropagation truncated to WINDOW steps, the state carried on from window to window; input
rows of words that a window doesn't hold stay as they are. Each training text is learnt from once: it falls into one of the
rounds (ROUNDS) and there into a shard, larger ones for a larger vocabulary, by its place in its file and a hash of its words,
so that copies part. In a round every shard takes a pass over its texts from the same weights and the same squares of past
gradients, by which steps are scaled; the shards' weights and squares are averaged.
Scoring carries each text's state across windows from its first token to its end.

A lookup of at most FREQUENT tokens goes to every task; the other tokens of each text are joined with the table of counts.
Null and empty texts are one end. With no training row N and V are 0 and every token has probability one. Repeated
rows and equal or null ids are texts of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import numbered, prepare, remainder, staged, with_row_key

END = b"\n"  # no word holds white space
VOCABULARY, FREQUENT = 1500, 300_000
#: A word needs so many occurrences to be learnt; a stream holds words in two bytes each.
LEAST_COUNT, MOST_WORDS = 500, 6_000
HIDDEN, WINDOW, LANES, LEAST_STEPS = 20, 20, 256, 50
SHARD_TOKENS = 300_000
#: The share of the training texts that each round learns from; from round to round the weights are averaged.
ROUNDS, RATE = (0.125, 0.25, 0.625), 0.1
#: So many sets of VOCABULARY words' weights are averaged at a time, fewer of a larger vocabulary; more of them in levels.
AVERAGED = 64
_FLUSH, _PIECE = 400_000, 1 << 15
_BUCKET_BITS = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MOST = np.float32(80)  # of what exp is taken


def tokens(text: str | None) -> list[bytes]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def counts(train: DataFrame) -> DataFrame:
    """Staged (word, c) of all tokens of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(tokens(text))
                if len(found) > _FLUSH:
                    yield rows()
        yield rows()

    return staged(train.select("text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "counts")


class Lookup:
    """N, V, and the frequent tokens: their base logarithms and their words in the model."""

    def __init__(self, n: int, v: int, frequent: list[tuple[bytes, int]]) -> None:
        self.n, self.v = n, v
        frequent = sorted(frequent, key=lambda x: (x[0] != END, -x[1], x[0]))
        self.index = {w: k for k, (w, _) in enumerate(frequent)}
        c = np.array([c for _, c in frequent], np.float64)
        self.base = np.log10((c + 1) / (n + v + 1))
        self.words = min(len(frequent), max(VOCABULARY, min(int((c >= LEAST_COUNT).sum()), MOST_WORDS)))
        self.other = self.words  # the model's word for all else
        own = c[: self.words]
        self.frequency = np.append(own, max(n - own.sum(), 1.0))
        self.log_other = log10(max(1 - float(((own + 1) / (n + v + 1)).sum()), 1e-300))

        data, at = hashing.buffers(pa.array(list(self.index), pa.large_binary()))
        keys = hashing.spans(data, at[:-1], at[1:]) if self.index else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.places = keys[order], order.astype(np.int32)
        self.buckets = np.searchsorted(self.keys, np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)).astype(np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": None}  # tasks look words up by their hashes

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each token among the frequent ones, or -1, by the token's hash."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.keys):
            return out
        bucket = (hashes >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        at, left = self.buckets[bucket], np.arange(len(hashes))
        last = np.append(self.buckets[1:], np.int32(len(self.keys)))[bucket]
        while True:
            inside = at < last
            left, at, last = left[inside], at[inside], last[inside]
            if not len(left):
                return out
            hit = self.keys[at] == hashes[left]
            out[left[hit]] = self.places[at[hit]]
            left, at, last = left[~hit], at[~hit] + 1, last[~hit]

    def words_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids < 0) | (ids >= self.words), self.other, ids)


def lookup(table: DataFrame, most: int = FREQUENT) -> Lookup:
    """The driver sees at most `most` tokens: those whose count is in the highest classes that together have no more."""
    n, v = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    grade = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    sizes = sorted(((r.g, r.n) for r in table.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for g, k in sizes:
        if total + k > most - 1:
            break
        least, total = g, total + k
    wanted = (grade >= least) if least is not None else F.lit(False)
    found = table.filter(wanted | (F.col("word") == F.lit(bytearray(END)))).toArrow()
    return Lookup(n, v, list(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True)))


_ENCODED = "n_tokens bigint, known bigint, base double, rest double, rare array<binary>, words binary"


def encoded(docs: DataFrame, look: Lookup) -> DataFrame:
    """docs (row_file, row_index, doc_id, text) without the texts, but with what the lookup says of them, and the model's words.

    known and base: of the tokens that the lookup holds; rare: the others; rest: what words outside of the model add to its score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(look)  # FREQUENT tokens at most
    end = look.index.get(END, -1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        ends = look.words_of(np.array([end], np.int32)).astype(np.uint16)[0]
        base = np.append(look.base, 0.0)
        for batch in batches:
            data, offsets = hashing.buffers(batch.column("text"))
            for a, b in hashing.groups(offsets):
                raw, n = _LOWER[data[offsets[a] : offsets[b]]], b - a
                which, first, last = hashing.words(raw, offsets[a : b + 1] - offsets[a])
                ids = look.ids(hashing.spans(raw, first, last)) if len(first) else np.zeros(0, np.int32)
                count = np.bincount(which, minlength=n)
                words = np.full(len(ids) + n, ends, np.uint16)
                words[np.arange(len(ids)) + which] = look.words_of(ids)
                at = np.append(0, np.cumsum(count + 1))
                known = np.bincount(which, ids >= 0, n).astype(np.int64) + (end >= 0)
                sums = np.bincount(which, base[ids], n) + base[end]
                other = (ids >= look.words) | (ids < 0)
                rest = np.bincount(which[other], base[ids[other]] - look.log_other, n) + (base[end] - look.log_other) * (not 0 <= end < look.words)
                rare = np.flatnonzero(ids < 0)
                size = last[rare] - first[rare]
                held = np.append(0, np.cumsum(size))
                letters = raw[np.repeat(first[rare] - held[:-1], size) + np.arange(held[-1])]
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(rare), [None, pa.py_buffer(held.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes())])
                edges = np.append(0, np.cumsum(np.bincount(which[rare], minlength=n))).astype(np.int32)
                streams = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 2).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
                columns = [pa.array(count + 1), pa.array(known), pa.array(sums), pa.array(rest), pa.ListArray.from_arrays(pa.array(edges), lists), streams]
                own = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("row_file", "row_index", "doc_id")), *columns], ["row_file", "row_index", "doc_id", *(x.split()[0] for x in _ENCODED.split(", "))])

    kind = dict(docs.dtypes)["doc_id"]
    return staged(docs.select("row_file", "row_index", "doc_id", "text").mapInArrow(encode, f"row_file bigint, row_index bigint, doc_id {kind}, {_ENCODED}"), "lmwords")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.minimum(np.negative(x, out=x), _MOST, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _summed(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct words, the sums of their rows)."""
    order = np.argsort(words, kind="stable")
    seen, first, n = np.unique(words[order], return_index=True, return_counts=True)
    out = rows[order[first]]
    several = n > 1
    if several.any():
        inside = np.repeat(several, n)
        out[several] = np.add.reduceat(rows[order[inside]], np.cumsum(n[several]) - n[several], axis=0)
    return seen, out


class Gru:
    """Weights: inputs (a row for each word), state, class outputs, word outputs (a row for each word); the last of an output's inputs is one."""

    def __init__(self, frequency: np.ndarray) -> None:
        words = len(frequency)
        rng = np.random.default_rng(4)
        root = np.cumsum(np.sqrt(frequency)) / np.sqrt(frequency).sum()
        classes = max(1, ceil(words**0.5 / 2))
        self.of = np.minimum((root * classes).astype(int), classes - 1)  # frequent words have small classes
        self.of = np.unique(self.of, return_inverse=True)[1].astype(np.int16)
        self.first = np.searchsorted(self.of, np.arange(self.of[-1] + 2))  # classes are runs of words
        f = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        share = np.bincount(self.of, frequency)
        self.w = {"x": f(words, 3 * HIDDEN), "u": f(HIDDEN, 3 * HIDDEN), "c": f(HIDDEN + 1, self.of[-1] + 1), "o": f(words, HIDDEN + 1)}
        self.w["c"][-1] = np.log(share / share.sum())
        self.w["o"][:, -1] = np.log(frequency / share[self.of])
        #: Sums of squared gradients: a row of x and of o shares one.
        self.squares = {k: np.full((words, 1) if k in "xo" else v.shape, 1e-8, np.float32) for k, v in self.w.items()}

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: the word's inputs."""
        y = h @ self.w["u"]
        gates = _sigmoid(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
        z, back = gates[:, :HIDDEN], y[:, 2 * HIDDEN :]
        new = gates[:, HIDDEN:] * back
        new += x[:, 2 * HIDDEN :]
        new += new
        new = _sigmoid(new)
        new += new
        new -= 1  # the hyperbolic tangent
        out = h - new
        out *= z
        out += new
        return out, gates, new, back

    def outputs(self, h: np.ndarray, word: np.ndarray, grad: bool = False):
        """Natural logarithm of each word's probability after its state; with grad, the gradients of the summed loss instead."""
        cls = self.of[word]
        order = np.argsort(cls, kind="stable")
        word, cls, rows = word[order], cls[order], np.arange(len(word))
        full = np.ones((len(word), HIDDEN + 1), np.float32)
        full[:, :HIDDEN] = h[order]
        e = full @ self.w["c"]
        found = None if grad else e[rows, cls]
        total = self._exp(e)
        if grad:
            e *= (1 / total)[:, None]
            e[rows, cls] -= 1
            dc, dh, do = full.T @ e, e @ self.w["c"].T, np.zeros_like(self.w["o"])
        else:
            found -= np.log(total)
        edges = np.searchsorted(cls, np.arange(len(self.first))).tolist()
        places = word - self.first[cls]
        for k, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            p, q = edges[k], edges[k + 1]
            if p == q or b - a < 2:
                continue
            state, weights = full[p:q], self.w["o"][a:b]
            e = state @ weights.T
            at = (rows[: q - p], places[p:q])
            if not grad:
                found[p:q] += e[at]
            total = self._exp(e)
            if grad:
                e *= (1 / total)[:, None]
                e[at] -= 1
                np.matmul(e.T, state, out=do[a:b])
                dh[p:q] += e @ weights
            else:
                found[p:q] -= np.log(total)
        out = np.empty((len(word), HIDDEN) if grad else len(word), np.float32)
        out[order] = dh[:, :HIDDEN] if grad else found
        return (out, dc, do) if grad else out

    @staticmethod
    def _exp(e: np.ndarray) -> np.ndarray:
        """Takes exp in place; the sum of each row. States lie between -1 and 1, so logits stay small; the bound is for safety."""
        np.exp(np.minimum(e, _MOST, out=e), out=e)
        return e @ np.ones(e.shape[1], np.float32)

    def train(self, stream: np.ndarray, end: int, rate: float) -> None:
        """One pass over the texts that `stream` holds one after another, each with its end, in LANES lanes."""
        lanes = min(LANES, max(1, len(stream) // (WINDOW * LEAST_STEPS)))
        length = ceil(len(stream) / lanes)
        if length < 1:
            return
        grid = np.resize(stream, lanes * length).reshape(lanes, length).T  # the last lane is filled up from the start
        before = np.vstack([np.full((1, lanes), end), grid[:-1]])
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, length, WINDOW):
            own = before[at : at + WINDOW]
            n, alive = len(own), (own != end).astype(np.float32)[:, :, None]  # a text begins with no state
            x = self.w["x"][own]
            h0, new, back, states = np.empty((4, n, lanes, HIDDEN), np.float32)
            gates = np.empty((n, lanes, 2 * HIDDEN), np.float32)
            for t in range(n):
                np.multiply(h, alive[t], out=h0[t])
                h, gates[t], new[t], back[t] = self.step(h0[t], x[t])
                states[t] = h
            dh, dc, do = self.outputs(states.reshape(-1, HIDDEN), grid[at : at + n].ravel(), grad=True)
            dh = dh.reshape(n, lanes, HIDDEN)
            z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
            by_new = (1 - z) * (1 - new * new)
            by_z = np.subtract(h0, new, out=new) * z * (1 - z)
            by_r = back * r * (1 - r)
            keeps, turned = z * alive, np.ascontiguousarray(self.w["u"].T)
            inner, dy = np.empty((n, lanes, 3 * HIDDEN), np.float32), np.empty((n, lanes, 3 * HIDDEN), np.float32)
            carry = np.zeros((lanes, HIDDEN), np.float32)
            for t in range(n - 1, -1, -1):
                d = dh[t]
                d += carry
                dn = d * by_new[t]
                inner[t, :, 2 * HIDDEN :] = dn
                np.multiply(d, by_z[t], out=dy[t, :, :HIDDEN])
                np.multiply(dn, by_r[t], out=dy[t, :, HIDDEN : 2 * HIDDEN])
                np.multiply(dn, r[t], out=dy[t, :, 2 * HIDDEN :])
                carry = dy[t] @ turned
                carry *= alive[t]
                d *= keeps[t]
                carry += d
            inner[:, :, : 2 * HIDDEN] = dy[:, :, : 2 * HIDDEN]
            du = h0.reshape(-1, HIDDEN).T @ dy.reshape(-1, 3 * HIDDEN)
            seen, dx = _summed(own.ravel(), inner.reshape(-1, 3 * HIDDEN))
            self.update({"x": dx, "u": du, "c": dc, "o": do}, seen, own.size, rate)

    def update(self, grads: dict[str, np.ndarray], seen: np.ndarray, n: int, rate: float) -> None:
        """A step against the gradients, each by its squares so far; of the inputs only the rows seen."""
        norm = sum(float(np.vdot(g, g)) for g in grads.values()) ** 0.5 / n
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / n)
        for k, g in grads.items():
            rows = seen if k == "x" else slice(None)
            g *= scale
            squares = self.squares[k][rows] + (np.einsum("ij,ij->i", g, g)[:, None] / g.shape[1] if k in "xo" else g * g)
            self.squares[k][rows] = squares
            g *= np.float32(rate) / np.sqrt(squares)
            self.w[k][rows] -= g

    def score(self, stream: np.ndarray, at: np.ndarray, end: int, window: int = 32) -> np.ndarray:
        """Natural logarithm of each whole text's probability; stream: the texts one after another, at: their offsets."""
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        length, first = length[order], at[:-1][order]
        out, h = np.zeros(len(order)), np.zeros((len(order), HIDDEN), np.float32)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            states, words, owners = (np.concatenate(x) for x in zip(*waiting, strict=True))
            for a in range(0, len(words), _PIECE):
                found = self.outputs(states[a : a + _PIECE], words[a : a + _PIECE]).astype(np.float64)
                out[:] += np.bincount(owners[a : a + _PIECE], found, len(out))
            waiting.clear()

        for begin in range(0, int(length[0]) if len(length) else 0, window):
            n = int(np.searchsorted(-length, -begin, "left"))
            t = np.arange(begin, min(begin + window, int(length[0])))[:, None]
            inside = t < length[None, :n]
            grid = stream[np.where(inside, first[None, :n] + t, 0)]
            before = np.vstack([stream[first[:n] + begin - 1] if begin else np.full(n, end, stream.dtype), grid[:-1]])
            h, states = h[:n], np.empty((len(t), n, HIDDEN), np.float32)
            for k in range(len(t)):
                h = self.step(h, self.w["x"][before[k]])[0]
                states[k] = h
            step, owner = np.nonzero(inside)
            waiting.append((states[step, owner], grid[step, owner], owner))
            if sum(len(x[1]) for x in waiting) >= _PIECE:
                flush()
        if waiting:
            flush()
        back = np.empty(len(out))
        back[order] = out
        return back


_PARTS = ("x", "u", "c", "o")
_WEIGHTS = "shard bigint, n bigint, " + ", ".join(f"{k} binary, {k}_squares binary" for k in _PARTS)
_NAMES = [x.split()[0] for x in _WEIGHTS.split(", ")[2:]]


def _row(shard: int, n: int, model: Gru) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n": [n], **{k: [model.w[k].tobytes()] for k in _PARTS}, **{f"{k}_squares": [model.squares[k].tobytes()] for k in _PARTS}})[["shard", "n", *_NAMES]]


def _averaged(frame: pd.DataFrame, averaged: int = AVERAGED) -> pd.DataFrame:
    """One set of weights in place of several, by their tokens; so too the squares of their gradients."""
    frame = frame.sort_values(["n", "u"])  # alike whatever the order of tasks
    total = frame["n"].sum()
    mean = {name: sum(np.frombuffer(w, np.float32) * np.float32(n / total) for w, n in zip(frame[name], frame["n"], strict=True)).tobytes() for name in _NAMES}
    return pd.DataFrame({"shard": [int(frame["shard"].iloc[0]) // averaged], "n": [total], **{k: [v] for k, v in mean.items()}})


def _mean(averaged: int):
    return lambda frame: _averaged(frame, averaged)


def _lesson(weights, end: int, rate: float):
    """What a shard does: a pass over its texts from the shared weights."""

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(w, np.uint16) for w in frame.sort_values(["row_file", "row_index"])["words"]]
        stream = np.concatenate(texts).astype(np.int64)
        own = weights.value
        fresh = Gru.__new__(Gru)
        fresh.of, fresh.first = own.of, own.first
        fresh.w, fresh.squares = {n: v.copy() for n, v in own.w.items()}, {n: v.copy() for n, v in own.squares.items()}
        fresh.train(stream, end, rate)
        return _row(int(frame["shard"].iloc[0]), len(stream), fresh)

    return learn


def trained(words: DataFrame, look: Lookup) -> Gru:
    """words: (row_file, row_index, words) of the training texts. Each text is learnt from once, in one of the rounds, in one of its shards."""
    model = Gru(look.frequency)
    if not look.n:
        return model
    larger = max(1.0, look.words / VOCABULARY)  # weights and texts of a shard stay in proportion
    averaged = max(2, int(AVERAGED / larger))
    # by the row alone, so that no group of copies comes as a whole
    place = F.pmod(F.xxhash64("row_index", F.length("words"), F.xxhash64("words")), F.lit(1 << 40)) / float(1 << 40)
    dealt = words.withColumn("place", place)
    end = look.words_of(np.array([look.index.get(END, -1)]))[0]
    begin = 0.0
    for share in ROUNDS:
        shards = max(1, round(look.n * share / (SHARD_TOKENS * larger)))
        learn = _lesson(words.sparkSession.sparkContext.broadcast(model), int(end), RATE)
        own = dealt.filter((F.col("place") >= begin) & (F.col("place") < begin + share))
        own = own.withColumn("shard", F.least(F.floor((F.col("place") - begin) / share * shards), F.lit(shards - 1)))
        learned, k, levels = own.repartition(shards, "shard").groupBy("shard").applyInPandas(learn, _WEIGHTS), shards, 0
        while k > averaged or not levels:  # once in any case, so that the driver gets few
            levels += 1
            learned, k = learned.groupBy(F.floor(F.col("shard") / averaged).alias("level")).applyInPandas(_mean(averaged), _WEIGHTS), ceil(k / averaged)
        found = learned.toPandas()  # `averaged` sets of weights at most
        begin += share
        if not len(found):
            continue
        mean = _averaged(found).iloc[0]
        for k in _PARTS:
            model.w[k] = np.frombuffer(mean[k], np.float32).reshape(model.w[k].shape).copy()
            model.squares[k] = np.frombuffer(mean[f"{k}_squares"], np.float32).reshape(model.squares[k].shape).copy()
    return model


def scored(rows: DataFrame, table: DataFrame, look: Lookup, model: Gru) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each text; rows: as `encoded` gives them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    end = int(look.words_of(np.array([look.index.get(END, -1)]))[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, before, batch in numbered(batches):
            data, at = hashing.buffers(batch.column("words"))
            learned = shared.value.score(data.view(np.uint16), at // 2, end) / np.log(10) + batch.column("rest").to_numpy()
            place = pa.array((np.arange(batch.num_rows) + before) | part << 40, pa.int64())
            yield pa.RecordBatch.from_arrays([place, *(batch.column(c) for c in ("doc_id", "n_tokens", "known", "base")), pa.array(learned), batch.column("rare")], ["place", "doc_id", "n_tokens", "known", "base", "learned", "rare"])

    kind = dict(rows.dtypes)["doc_id"]
    out = staged(rows.select("doc_id", "n_tokens", "known", "base", "rest", "rare", "words").mapInArrow(score, f"place bigint, doc_id {kind}, n_tokens bigint, known bigint, base double, learned double, rare array<binary>"), "lmscores")
    rare = out.select("place", F.explode("rare").alias("word")).join(table, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(look.n + look.v + 1)))
    others = rare.groupBy("place").agg(F.count("c").alias("more"), F.sum(log).alias("log"))
    out = out.drop("rare").join(others, "place", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + log).alias("base_score"), (F.col("learned") + log).alias("score"))


def language_model(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    prepare(docs.sparkSession)
    fold = remainder(F.col("doc_id"), 7)
    table = counts(docs.select("doc_id", "text").filter(fold != 2))
    look = lookup(table)
    rows = encoded(with_row_key(docs.select("doc_id", "text")), look)
    model = trained(rows.filter(fold != 2).select("row_file", "row_index", "words"), look)
    out = scored(rows, table, look, model)
    return out.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", F.lit(look.n).cast("bigint").alias("train_tokens"), "base_score", "score")
