"""Operator 7, benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A CGK walk reads a string by steps; at each step it notes the character under its pointer, and a random bit that depends
on the step and the character says whether the pointer moves on. Strings at a small edit distance fall back into step, so
their walks are at a small Hamming distance. A repetition samples some of the walk's first notes as its key; shorter items
have shorter walks, shorter keys and more repetitions (PLANS). Items have a walk from each of their word starts that
usually has room for it (items shorter than a walk also one over a window of their own size), documents from every word start,
with the same random bits; runs without white space that are long, or of a script without it, have walks from their inside
too: of items from every ITEM_EVERY characters, of documents from every one. A document's walk is dropped as soon as the
notes sampled so far begin no item's key: the same outcome as comparing whole keys. Equal keys say where the item would
start; that makes an item-sized window a candidate, for longer items (Plan.hits) only if another of the item's anchors says
about the same start. The item is then searched for in the window with a margin, by exact edit distance: it is in the
document if a substring is within MOST_EDITS of the item's length. Items that share an opening are candidates together where
it occurs, and are verified together.

Item and text are compared in lower case, with each run of white space as one space. Null, empty and blank items match
nothing; null and empty texts hold nothing. Equal items of different ids each match; repeated documents, equal and null ids
are rows of their own. Empty tables give no rows. `clean` keeps further columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import filtered, prepare

MOST_EDITS = 0.2
#: Items that go to a task at a time; more are taken in blocks, each against all documents.
BLOCK_ITEMS = 20_000
#: A longer run without white space isn't one word.
LONG_RUN, ITEM_EVERY = 16, 4
#: Scripts that set no spaces between words: Thai to Myanmar, Khmer, Chinese and Japanese.
_UNSPACED = np.array([[0xE00, 0x10A0], [0x1780, 0x1800], [0x2E80, 0xAC00], [0xF900, 0xFB00], [0x20000, 0x40000]], np.uint32)
#: Fewer candidates are verified one by one; of more, so many together.
_FEW, _TOGETHER = 32, 2048
#: Characters of windows that wait for their verification.
_HELD = 1 << 21
#: Share of an item, in whole blocks of 64 characters, that is searched for first.
_OPENING = 0.4
#: Characters that are walked over together.
_PIECE = 1 << 19


def walk_starts(chars: np.ndarray, at: np.ndarray, every: int) -> np.ndarray:
    """Word starts, and every so many characters of runs that aren't one word."""
    inside = chars != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(chars))]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    size = np.flatnonzero(last) + 1 - starts
    several = size > LONG_RUN
    if chars.max() >= _UNSPACED[0, 0]:
        unspaced = np.searchsorted(_UNSPACED.ravel(), chars, "right") % 2 == 1
        held = np.append(0, np.cumsum(unspaced))
        several |= held[starts + size] > held[starts]
    if not several.any():
        return starts
    n = np.where(several, (size + every - 1) // every, 1)
    return np.repeat(starts, n) + every * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


class Plan:
    """Walks of `steps`, of which `stages[-1]` notes are sampled in each repetition; `hits` anchors must agree on the item's place."""

    def __init__(self, least: int, steps: int, repetitions: int, stages: tuple[int, ...], hits: int) -> None:
        rng = np.random.default_rng(7)
        self.least, self.steps, self.repetitions, self.stages, self.hits = least, steps, repetitions, stages, hits
        self.seeds = rng.integers(0, 1 << 32, repetitions, np.uint64).astype(np.uint32)
        self.samples = [np.sort(rng.choice(steps, stages[-1], replace=False)) for _ in range(repetitions)]
        self.room = steps * 5 // 8  # a walk moves on at half of its steps


#: By the least length of their items. Windows of an item's own size have OWN_REPETITIONS.
PLANS = [Plan(150, 32, 6, (5, 7, 9, 12), 2), Plan(80, 28, 10, (4, 6, 8, 11), 2), Plan(40, 24, 7, (3, 5, 7, 9), 1), Plan(0, 16, 12, (4, 6), 1)]
STEPS, OWN_REPETITIONS = max(plan.steps for plan in PLANS), 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(0x3002, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def normalized(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, characters, offsets, place of each character in its group's texts) of groups of texts."""
    data, offsets = hashing.buffers(texts)
    for a, b in hashing.groups(offsets):
        points, at = hashing.code_points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        lower = hashing._LOWER.take(points, mode="clip")
        points = lower if len(points) and points.max() < len(hashing._LOWER) else np.where(points < len(hashing._LOWER), lower, points)
        space = _SPACE.take(points, mode="clip")
        again = np.zeros(len(points), bool)
        again[1:] = space[1:] & space[:-1]
        starts = at[:-1][at[:-1] < len(points)]
        again[starts] = space[starts]  # no space at a text's start
        kept = np.append(np.flatnonzero(~again), len(points)) if len(points) else np.zeros(1, np.int64)
        np.putmask(points, space, np.uint32(32))
        yield a, b, points.take(kept[:-1]), np.searchsorted(kept[:-1], at), kept


def _mixed(chars: np.ndarray, seed: np.uint32) -> np.ndarray:
    x = (chars.astype(np.uint32) ^ seed) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ x >> np.uint32(16)


@cache
def _common(seed: int) -> np.ndarray:
    return _mixed(np.arange(1 << 16), np.uint32(seed))


def _symbols(chars: np.ndarray, seed: np.uint32) -> np.ndarray:
    """32 random bits for each character, 0 beyond the end. Bit t says whether a walk moves on at step t."""
    out = np.zeros(len(chars) + STEPS + 1, np.uint32)
    _common(int(seed)).take(chars, mode="clip", out=out[: len(chars)])
    if len(chars) and chars.max() >= 1 << 16:
        rare = np.flatnonzero(chars >= 1 << 16)
        out[rare] = _mixed(chars[rare], seed)
    return out


class Path:
    """What walks of one seed read from their starts, step by step: kept for the plans that have the seed in common."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        self.symbols, self.starts, self.pointer = symbols, starts.astype(np.int32), starts.astype(np.int32)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []

    def read(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(pointers, symbols under them) of all walks at a step."""
        while len(self.steps) <= step:
            c = self.symbols.take(self.pointer, mode="clip")
            self.steps.append((self.pointer, c))
            self.pointer = self.pointer + _moves(c, len(self.steps) - 1)
        return self.steps[step]


def _moves(c: np.ndarray, step: int) -> np.ndarray:
    on = c >> np.uint32(step)
    on &= np.uint32(1)
    return on.view(np.int32)


def walk(symbols: np.ndarray, starts: np.ndarray, repetition: int, size: int, plan: Plan, tables: list[np.ndarray] | None = None, path: Path | None = None):
    """Without tables the keys at each stage; with tables (places among starts, keys) of the walks that pass every stage's table."""
    path = path or Path(symbols, starts)
    alive, own, end = None, size < plan.steps, path.starts + size
    key = np.full(len(end), min(size, plan.steps), np.uint64)
    stages, sample, n = [], plan.samples[repetition].tolist(), 0
    for step in range(sample[-1] + 1):
        if alive is None:
            pointer, c = path.read(step)
        else:
            c = symbols.take(pointer, mode="clip")
        if own:
            c = np.where(pointer < end, c, np.uint32(0))
        if step == sample[n]:
            key ^= c.astype(np.uint64)
            key *= _ODD
            n += 1
            if n in plan.stages:
                if tables is None:
                    stages.append(key.copy())
                else:
                    table = tables[plan.stages.index(n)]
                    passes = np.flatnonzero(table.take(_places(key, len(table)), mode="clip"))
                    pointer, key, c = pointer.take(passes), key.take(passes), c.take(passes)
                    alive = passes if alive is None else alive.take(passes)
                    end = end.take(passes) if own else end
        if alive is not None:
            pointer += _moves(c, step)
    return stages if tables is None else (alive, key)


def _table(keys: np.ndarray) -> np.ndarray:
    """Whether a key may be one of `keys`, by its top bits."""
    bits = min(max(len(keys).bit_length() + 4, 12), 24)
    table = np.zeros(1 << bits, bool)
    table[_places(keys, len(table))] = True
    return table


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    places = keys * _ODD
    places >>= np.uint64(65 - size.bit_length())
    return places.view(np.int64)


class Items:
    """The items' walks and what the verification needs."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.ids, self.text = [], []
        anchors: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by plan and size
        texts = pa.array([text or "" for _, text in items], pa.large_string())
        own_texts = [chars[a:b] for _, _, chars, at, _ in normalized(texts) for a, b in zip(at[:-1], at[1:], strict=True)]
        for (item, _), own in zip(items, own_texts, strict=True):
            own = own[:-1] if len(own) and own[-1] == 32 else own
            if not len(own):
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.text.append(own)
            n = next(n for n, plan in enumerate(PLANS) if len(own) >= plan.least)
            if len(own) < PLANS[n].steps:
                anchors.setdefault((n, len(own)), []).append((k, 0))
            starts = walk_starts(own, np.array([0, len(own)]), ITEM_EVERY)
            room = starts[starts <= len(own) - PLANS[n].room]
            if len(own) >= PLANS[n].steps and not len(room):
                room = [0]
            anchors.setdefault((n, PLANS[n].steps), []).extend((k, int(q)) for q in room)
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.hits = np.array([next(p.hits for p in PLANS if m >= p.least) for m in self.sizes], np.int64)
        gap = np.zeros(STEPS + 1, np.uint32)
        every = np.concatenate([x for own in self.text for x in (own, gap)] or [gap])
        first = np.cumsum(self.sizes + len(gap)) - self.sizes - len(gap)
        self.walks = []  # (plan, size, repetition, keys of the earlier stages, sorted keys, their items, their places)
        for (n, size), own in anchors.items():
            plan = PLANS[n]
            flat = np.array(own, np.int64).reshape(-1, 2)
            for repetition in range(min(plan.repetitions, OWN_REPETITIONS) if size < plan.steps else plan.repetitions) if len(flat) else ():
                symbols = np.where(np.append(every, gap) > 0, _symbols(every, plan.seeds[repetition]), np.uint32(0))
                stages = walk(symbols, first[flat[:, 0]] + flat[:, 1], repetition, size, plan)
                order = np.argsort(stages[-1], kind="stable")
                self.walks.append((plan, size, repetition, [np.unique(k) for k in stages[:-1]], stages[-1][order], flat[order, 0], flat[order, 1]))
        self.walks.sort(key=lambda x: x[2])  # plans share the seeds of their repetitions
        self.tables = self.masks = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None, "masks": None}  # a task makes its own

    def mask(self, item: int) -> dict[int, int]:
        """The places of each character in an item, as bits."""
        if self.masks is None:
            self.masks = {}
        if item not in self.masks:
            masks = self.masks[item] = {}
            for i, c in enumerate(self.text[item].tolist()):
                masks[c] = masks.get(c, 0) | 1 << i
        return self.masks[item]

    def candidates(self, chars: np.ndarray, at: np.ndarray, most_edits: float = MOST_EDITS) -> np.ndarray:
        """Rows (text, item, about where in the group the item would start, in units of 32), in order."""
        if self.tables is None:
            self.tables = [[*map(_table, stages), _table(keys)] for _, _, _, stages, keys, _, _ in self.walks]
        found = [np.zeros((4, 0), np.int64)]
        for a, b in hashing.groups(at, _PIECE):
            part = self._walked(chars[at[a] : at[b]], at[a : b + 1] - at[a])
            part[0] += a
            part[2] += at[a]
            found.append(part)
        text, item, first, place = np.concatenate(found, axis=1)
        if not len(text):
            return np.zeros((0, 3), np.int64)
        order = np.lexsort((place, first, item, text))
        text, item, first, place = text[order], item[order], first[order], place[order]
        close = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (place[1:] != place[:-1])
        close &= first[1:] - first[:-1] <= np.maximum(most_edits * self.sizes[item[1:]] / 4, 3)
        good = self.hits[item] < 2
        good[1:] |= close
        good[:-1] |= close
        rows = np.stack([text[good], item[good], first[good] >> 5], axis=1)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        return rows[new]

    def _walked(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(text, item, about where the item would start, place of the anchor in it) of the walks that an item has too."""
        starts = walk_starts(chars, at, 1)
        found = [np.zeros((4, 0), np.int64)]
        seed, wide = None, chars.astype(np.intp)  # as numpy takes places
        for (plan, size, repetition, _, keys, items, places), tables in zip(self.walks, self.tables, strict=True):
            if seed != plan.seeds[repetition]:
                seed = plan.seeds[repetition]
                symbols = _symbols(wide, seed)
                path = Path(symbols, starts)
            alive, key = walk(symbols, starts, repetition, size, plan, tables, path)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            n = hi - lo
            which = np.repeat(np.arange(len(key)), n)
            entry = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            position = starts[alive[which]]
            found.append(np.stack([np.searchsorted(at, position, "right") - 1, items[entry], position - places[entry], places[entry]]))
        return np.concatenate(found, axis=1)

    def _near(self, waiting: list[tuple], most_edits: float) -> np.ndarray:
        """Which windows may hold their item, for many windows at a time: those that are within the distance, or a few that the item's opening is.

        The openings are searched for first, as they are no farther than the whole items are, in overlapping windows of a text at once.
        """
        if len(waiting) < _FEW:
            return np.ones(len(waiting), bool)
        which, items, windows = _joined(waiting)
        opening = np.minimum(np.ceil(_OPENING * self.sizes / 64).astype(np.int64) * 64, self.sizes)
        out = self._within(items, windows, opening, most_edits)[which]
        left = np.flatnonzero(out)
        if len(left) >= 4 * _FEW:
            out[left] = self._within(np.array([waiting[k][1] for k in left]), [waiting[k][2] for k in left], self.sizes, most_edits)
        return out

    def _within(self, items: np.ndarray, windows: list[np.ndarray], sizes: np.ndarray, most_edits: float) -> np.ndarray:
        """Whether so many of the items' first characters are in their windows within the whole items' edits."""
        size, most = sizes[items], most_edits * self.sizes[items] + 1e-9
        length = np.array([len(w) for w in windows])
        out = np.zeros(len(items), bool)
        blocks = (size + 63) // 64
        for n in np.unique(blocks).tolist():
            alike = np.flatnonzero(blocks == n)
            alike = alike[np.argsort(length[alike], kind="stable")]
            together = max(_TOGETHER // n, 1)
            for k in range(0, len(alike), together):
                own = alike[k : k + together]
                last = np.cumsum(length[own])
                out[own] = self._distances(items[own], last - length[own], last, np.concatenate([windows[i] for i in own]), sizes) <= most[own]
        return out

    def _distances(self, items: np.ndarray, first: np.ndarray, last: np.ndarray, chars: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Least edit distance of each item, or of so many of its first characters, to a substring of its window: Myers' bits in blocks of 64."""
        distinct, which = np.unique(items, return_inverse=True)
        size = (self.sizes if sizes is None else sizes)[distinct]
        texts = [self.text[k][:n] for k, n in zip(distinct, size, strict=True)]
        every = np.concatenate(texts)
        letters = np.unique(every)
        blocks = int(size.max() + 63) // 64
        if len(distinct) > 1 and len(distinct) * blocks * len(letters) > 1 << 22:
            half = len(items) // 2
            return np.concatenate([self._distances(items[a], first[a], last[a], chars, sizes) for a in (slice(half), slice(half, None))])
        masks = np.zeros((blocks, len(letters) + 1, len(distinct)), np.uint64)  # the last letter is any other
        place = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
        own = ((place >> 6) * (len(letters) + 1) + np.searchsorted(letters, every)) * len(distinct) + np.repeat(np.arange(len(distinct)), size)
        np.bitwise_or.at(masks.ravel(), own, np.uint64(1) << (place & 63).astype(np.uint64))
        code = np.full(int(max(letters[-1], chars.max(initial=0))) + 1, len(letters) * len(distinct), np.intp)
        code[letters] = np.arange(len(letters)) * len(distinct)
        other, code = len(letters) * len(distinct) + which, code.take(chars)
        layer = np.arange(blocks)[:, None] * masks[0].size
        masks = masks.ravel()
        one, top = np.uint64(1), np.uint64(63)
        plus, minus = np.full((blocks, len(items)), ~np.uint64(0)), np.zeros((blocks, len(items)), np.uint64)
        up, down = np.zeros_like(minus), np.zeros_like(minus)
        full = bool((size == 64 * blocks).all())  # all end in the last block, at its last bit
        last_block, bit = (size[which] - 1) // 64 * len(items) + np.arange(len(items)), ((size[which] - 1) % 64).astype(np.uint64)
        score = size[which].astype(np.int64)
        best = score.copy()
        # All blocks at a time, each a column behind the one before it. Columns outside of a window hold no letter of an item, which leaves the start as it is and betters no end.
        length = last - first
        least, held = int(length.min()), layer + other
        for k in range(int(length.max()) + blocks - 1):
            for block in range(blocks - 1, 0, -1):
                np.add(held[block - 1], layer[1], out=held[block])
            if k < least:
                np.add(code.take(first + k, mode="clip"), which, out=held[0])
            else:
                held[0] = np.where(k < length, code.take(first + k, mode="clip") + which, other) if len(code) else other
            eq = masks.take(held, mode="clip")
            xv = eq | minus
            eq |= down
            xh = eq & plus
            xh += plus
            xh ^= plus
            xh |= eq
            ph = xh | plus
            np.invert(ph, out=ph)
            ph |= minus
            xh &= plus  # from here on the steps down
            if full:
                score += (ph[-1] >> top).view(np.int64)
                score -= (xh[-1] >> top).view(np.int64)
            else:
                score += (ph.take(last_block) >> bit & one).view(np.int64)
                score -= (xh.take(last_block) >> bit & one).view(np.int64)
            np.minimum(best, score, out=best)
            next_up, next_down = ph[:-1] >> top, xh[:-1] >> top
            ph <<= one
            ph |= up
            xh <<= one
            xh |= down
            np.bitwise_or(xv, ph, out=plus)
            np.invert(plus, out=plus)
            plus |= xh
            np.bitwise_and(ph, xv, out=minus)
            up[1:], down[1:] = next_up, next_down
        return best

    def _verify(self, waiting: list[tuple], most_edits: float, out: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Puts the nearest places of (text, item, characters of a window, their places) into out."""
        for k in np.flatnonzero(self._near(waiting, most_edits)).tolist():
            text, item, chars, places = waiting[k]
            best = out.get((text, item))
            if best and best[0] == 0:
                continue
            got = located(self.text[item], self.mask(item), chars.tolist(), int(most_edits * len(self.text[item]) + 1e-9))
            if got:
                new = (got[0], int(places[got[1]]), int(places[got[2] - 1]) + 1)
                out[(text, item)] = min(best, new) if best else new
        waiting.clear()

    def _windows(self, chars: np.ndarray, at: np.ndarray, places: np.ndarray, most_edits: float) -> Iterator[tuple]:
        for text, item, about in self.candidates(chars, at, most_edits).tolist():
            k = int(most_edits * self.sizes[item] + 1e-9)
            first, last = max(int(at[text]), (about << 5) - k), min(int(at[text + 1]), (about + 1 << 5) + int(self.sizes[item]) + k)
            yield text, item, chars[first:last].copy(), places[first:last].copy()

    def matches(self, chars: np.ndarray, at: np.ndarray, most_edits: float = MOST_EDITS) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item): the least (distance, start, end), places counted in the group."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        self._verify(list(self._windows(chars, at, np.arange(len(chars)), most_edits)), most_edits, out)
        return out

    def search(self, texts: pa.Array, most_edits: float = MOST_EDITS) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item): the least (distance, start, end), places counted in the text's code points."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        waiting: list[tuple] = []
        held = 0
        for a, _, chars, at, place in normalized(texts):
            for text, item, own, places in self._windows(chars, at, place, most_edits):
                waiting.append((a + text, item, own, places - place[at[text]]))
                held += len(own)
                if held >= _HELD:
                    self._verify(waiting, most_edits, out)
                    held = 0
        self._verify(waiting, most_edits, out)
        return out


def _joined(waiting: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(the joined window of each window, items, joined windows): windows of one text and item that are nearly at the same place, as they follow each other, are one."""
    which, items, windows = [], [], []
    before, room = None, 0
    for text, item, chars, places in waiting:
        new = len(chars)
        if before and len(places) and before[:2] == (text, item) and before[2][0] <= places[0] <= before[2][-1]:
            new -= len(before[2]) - int(np.searchsorted(before[2], places[0]))
        if new < len(chars) and new <= room:
            room -= max(new, 0)
            windows[-1].append(chars[len(chars) - new :] if new > 0 else chars[:0])
        else:
            items.append(item)
            windows.append([chars])
            room = 64
        which.append(len(items) - 1)
        before = text, item, places
    return np.array(which), np.array(items), [w[0] if len(w) == 1 else np.concatenate(w) for w in windows]


def _scan(masks: dict[int, int], m: int, text, anchored: bool) -> tuple[int, int]:
    """(least distance of the pattern to a substring that ends somewhere, that end); anchored: substrings from the text's start on only."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, i
    return best, end


def located(item: np.ndarray, masks: dict[int, int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest substring of text, if within `most` edits."""
    m = len(item)
    distance, end = _scan(masks, m, text, False)
    if distance > most:
        return None
    turned = {c: int(f"{bits:0{m}b}"[::-1], 2) for c, bits in masks.items()}
    _, back = _scan(turned, m, text[:end][::-1], True)
    return distance, end - back, end


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[Items]:
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    n = max(1, ceil(items.count() / block_items))
    for k in range(n):
        yield Items(sorted(((r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()), key=lambda x: (x[0] is not None, x[0], x[1])))


def leaks(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, distance, start and end (code points of the text, end exclusive) of the nearest place, a row for each document and item in it."""
    prepare(docs.sparkSession)
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    out = None
    for items in _blocks(benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # block_items items at most

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[text], shared.value.ids[item], *found) for (text, item), found in shared.value.search(batch.column("text"), most_edits).items()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "distance", "start", "end"])

        found = docs.select("doc_id", "text").mapInArrow(_one(search), f"doc_id {kinds[0]}, item_id bigint, distance bigint, start bigint, end bigint")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("item_id", F.col("item_id").cast(kinds[1]))


def _one(f):
    return lambda x: f(x)


def clean(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs that hold no item."""
    prepare(docs.sparkSession)
    for items in _blocks(benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # block_items items at most

        def keep(texts: pa.Array, shared=shared) -> np.ndarray:
            good = np.ones(len(texts), bool)
            good[[text for text, _ in shared.value.search(texts, most_edits)]] = False
            return good

        docs = filtered(docs, _one(keep))
    return docs
