"""Operator 13, byte-level BPE: Spark's higher-order functions fold ranked merges over the bytes of distinct words.

1. `cut` splits every text by the fixed pattern and writes, block by block (some megabytes of a task's texts), each document
   as codes of its words, and the block's distinct words.
2. The words are dealt out in groups by hash; each is encoded once for all blocks of a span of partitions, so that common
   words are no hot group: one meets at most the blocks of SPAN partitions. Its bytes, a text of Latin-1 characters, are folded: a state holds a
   number for each part, the rank of the part with its successor and where the part begins. The least number is the pair
   to merge, leftmost among equal ranks. The rank map is a literal, dealt to buckets by CRC-32, as Spark searches a map
   from end to end. A word of over LONG bytes merges all pairs of the least rank at once: a merge never makes a pair of
   lower rank, for every piece of such a vocabulary is the merge of its own bytes.
3. The ids of a block's words meet the block's codes again; documents get their ids, and decoding joins the ids' bytes.

Null and empty texts have no tokens. Repeated rows and equal or null ids are rows of their own. An empty table gives an
empty result. Columns other than doc_id and text are passed over, whatever their names. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, prepare, staged, texts_of

#: The split pattern of this family of tokenizers (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of a block and documents of one of its rows, partitions whose words are encoded together, buckets of the rank map.
BLOCK_WORDS, SLICE, SPAN, BUCKETS = 8_000_000, 512, 1024, 1 << 16
#: Groups, by hash, of the words of a span.
GROUPS = 512
#: Encoded words that a task gathers before it packs them by block.
PENDING = 200_000
#: Bytes from which all pairs of the least rank are merged at once.
LONG = 256

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_RUN = re.compile(f"[{_WS}] ")
_SPLIT = regex.compile(PATTERN)
_RARE = re.compile("[^\\0-\u024f]")  # no character up to here is young


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


# --- words of texts ------------------------------------------------------------------------------------------------


@cache
def _stand_in(c: str) -> str:
    """c, or for a character younger than Python's own tables one of the class that tiktoken puts it in."""
    if unicodedata.category(c) != "Cn":
        return c
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    is_in = lambda kind: bool(tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(c))
    return "é" if is_in(r"\p{L}") else "1" if is_in(r"\p{N}") else "!"


def split(text: str) -> list[str]:
    """The matches of the pattern, which cover the text."""
    plain = "".join(map(_stand_in, text)) if _RARE.search(text) else text
    found = _SPLIT.findall(plain)
    if plain == text:
        return found
    ends = np.cumsum([0, *map(len, found)]).tolist()
    return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Dictionary:
    """The distinct words of a block by code. Texts are cut before each run of white space; what a chunk is made of is remembered."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # chunks that begin with a space, by what follows it
        self.seen = 0

    def _of(self, known: dict[str, bytes], chunks: list[str], lead: str) -> bytes:
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            codes = self.codes
            for c in chunks:
                if c not in known:
                    known[c] = array("i", [codes.setdefault(w, len(codes)) for w in split(lead + c)]).tobytes()
            return b"".join([known[c] for c in chunks])

    def coded(self, text: str) -> bytes:
        if _RUN.search(text):
            out = self._of(self.plain, _CHUNK.findall(text), "")
        else:
            first, *rest = text.split(" ")
            out = self._of(self.plain, _CHUNK.findall(first), "") + self._of(self.spaced, rest, " ")
        self.seen += len(out) // 4
        return out


def _packed(codes: bytes) -> bytes:
    """Codes compressed, their low bytes first and together, then the next."""
    planes = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 5).compress(planes.tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<i4")


def cut(docs: DataFrame) -> DataFrame:
    """Staged rows of two kinds, of a block each: (doc_ids, sizes, codes) of some documents; or (group, words, places), the words of a group and their codes."""
    prepare(docs.sparkSession)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "doc_ids", "sizes", "codes", "group", "words", "places"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, kinds, span = None, Dictionary(), None, 0

        def row(*values: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, *values), kinds, strict=True)], names)

        def dictionary() -> Iterator[pa.RecordBatch]:
            dealt: list[list[tuple[bytes, int]]] = [[] for _ in range(GROUPS)]
            for word, code in own.codes.items():
                raw = word.encode()
                dealt[zlib.crc32(raw) % GROUPS].append((raw, code))
            for k, words in enumerate(dealt):
                if words:
                    words.sort()  # neighbours that begin alike compress well
                    yield row(None, None, None, span * GROUPS + k, *zip(*words, strict=True))

        for part, _, batch in numbered(batches):
            kinds = [pa.int64(), pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            block, span = part << 32 if block is None else block, part // SPAN
            texts = texts_of(batch)
            for at in range(0, len(texts), SLICE):
                coded = [own.coded(t) for t in texts[at : at + SLICE]]
                yield row(batch.column("doc_id")[at : at + SLICE], [len(c) // 4 for c in coded], _packed(b"".join(coded)), None, None, None)
                if own.seen >= BLOCK_WORDS:
                    yield from dictionary()
                    block, own = block + 1, Dictionary()
        if own.seen:
            yield from dictionary()

    schema = f"block bigint, doc_ids array<{doc_type}>, sizes array<int>, codes binary, group int, words array<binary>, places array<int>"
    return staged(docs.select("doc_id", "text").mapInArrow(rows, schema), "words", bucket_by="block")


# --- the fold ------------------------------------------------------------------------------------------------------

_PLACE = (1 << 31) - 1
_NO_PAIR = 1 << 62
_TO_THE_END = 1 << 30


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal: for each bucket of CRC-32 the ranks of its pieces, whose bytes are Latin-1 characters."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")  # of a literal, so a literal itself


def _encoded(word: Column, table: Column) -> Column:
    rank = lambda piece: F.try_element_at(F.get(table, (F.crc32(piece) % BUCKETS).cast("int")), piece)
    n, none, rest = F.octet_length(word), F.lit(_NO_PAIR), F.lit(_TO_THE_END)
    begin = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")

    def folded(piece: Callable[[Column, Column], Column], merged: Callable[..., Column]) -> Column:
        """piece(a, b): the bytes from a to b; merged(s, low, pair): s with what its least number stands for merged."""
        pair = lambda a, b: F.coalesce(F.shiftleft(rank(piece(a, b)).cast("bigint"), 31), none).bitwiseOR(a.cast("bigint"))
        places = F.sequence(F.lit(0), n - 1)
        first = F.transform(places, lambda i: F.when(i < n - 1, pair(i, i + 2)).otherwise(none.bitwiseOR(i.cast("bigint"))))
        state = lambda s: F.struct(s.alias("s"), F.array_min(s).alias("low"))
        step = lambda x, _: F.when(x["low"] >= none, x).otherwise(_bound(merged(x["s"], x["low"], pair), state))
        ends = F.aggregate(F.slice(places, 2, rest), _bound(first, state), step)["s"]
        of = lambda s: F.transform(s, lambda x, i: rank(piece(begin(x), F.coalesce(begin(F.get(s, i + 1)), n))))
        return _bound(ends, of)

    def one(s: Column, low: Column, pair: Callable) -> Column:
        def at(i: Column) -> Column:  # the pair is at i, from 1 on
            start = lambda k: F.coalesce(begin(F.get(s, k)), n)
            before = F.when(i >= 2, F.concat(F.slice(s, 1, i - 2), F.array(pair(start(i - 2), start(i + 1))))).otherwise(F.slice(s, 1, 0))
            own = F.when(F.size(s) > i + 1, pair(start(i - 1), start(i + 2))).otherwise(none.bitwiseOR(begin(F.get(s, i - 1)).cast("bigint")))
            return F.concat(before, F.array(own), F.slice(s, i + 2, rest))

        return _bound(F.array_position(s, low).cast("int"), at)

    def all_of_rank(s: Column, low: Column, pair: Callable) -> Column:
        """Pairs of the least rank are merged from the left, none of them overlapping."""
        hit = F.array_join(F.transform(s, lambda x: F.when(F.shiftright(x, 31) == F.shiftright(low, 31), "1").otherwise("0")), "")
        new = F.lit(-1 << 31)  # marks a merged part, whose rank is to be found

        def with_flags(flags: Column) -> Column:
            on = lambda i: (i >= 0) & (F.substring(flags, i + 1, F.lit(1)) == F.lit(b"1"))
            kept = F.transform(s, lambda x, i: F.when(on(i - 1), F.lit(None).cast("bigint")).when(on(i), new.bitwiseOR(begin(x).cast("bigint"))).otherwise(x))

            def ranked(parts: Column) -> Column:
                start = lambda k: F.coalesce(begin(F.get(parts, k)), n)
                touched = lambda x, i: (x < 0) | (F.coalesce(F.get(parts, i + 1), F.lit(0)) < 0)
                found = lambda x, i: F.when(F.get(parts, i + 1).isNull(), none.bitwiseOR(begin(x).cast("bigint"))).otherwise(pair(begin(x), start(i + 2)))
                return F.transform(parts, lambda x, i: F.when(touched(x, i), found(x, i)).otherwise(x))

            return _bound(F.filter(kept, lambda x: x.isNotNull()), ranked)

        return _bound(F.replace(hit, F.lit("11"), F.lit("10")).cast("binary"), with_flags)

    def of_text(text: Column) -> Column:
        return folded(lambda a, b: F.substring(text, a + 1, b - a), one)

    long = folded(lambda a, b: F.decode(F.substring(word, a + 1, b - a), "ISO-8859-1"), all_of_rank)
    return F.when(n == 0, F.array().cast("array<int>")).when(n > LONG, long).otherwise(_bound(F.decode(word, "ISO-8859-1"), of_text))


def word_ids(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word's bytes."""
    return _bound(rank_map(ranks), lambda table: _encoded(word, table))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids: their pieces, concatenated. An id that no piece has is passed over."""
    hexes = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        hexes[rank] = piece.hex()
    pieces = F.from_json(F.lit(json.dumps(hexes)), "array<string>")
    return _bound(pieces, lambda table: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")))


def encoded_words(blocks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, words, tokens, codes, counts, ids) of each block's words, many in a row: the steps between their codes, how many ids each has, and the
    ids, as packed numbers."""
    own = blocks.filter("words is not null").select("group", "block", "words", "places").repartition("group")
    own = own.select("group", "block", F.explode(F.arrays_zip("words", "places")).alias("x")).select("group", F.col("x.words").alias("word"), "block", F.col("x.places").alias("code"))
    own = own.groupBy("group", "word").agg(F.collect_list("block").alias("blocks"), F.collect_list("code").alias("codes"))
    own = own.select(word_ids(F.col("word"), ranks).alias("ids"), "blocks", "codes")
    small = max(ranks.values(), default=0) < 1 << 16

    def packed(words: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        block, code, count, ids = (np.concatenate(x) for x in zip(*words, strict=True))
        ends = np.cumsum(count)
        order = np.lexsort((code, block))
        for mine in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            many = count[mine]
            after = np.cumsum(many)
            at = np.arange(after[-1]) + np.repeat(ends[mine] - after, many)
            columns = (_packed(np.diff(code[mine], prepend=0).astype("<i4").tobytes()), _packed(many.astype("<i4").tobytes()), pa.compress(ids[at].astype("<u2" if small else "<u4").tobytes(), "zstd", asbytes=True))
            numbers = (block[mine[0]], len(mine), len(at))
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in numbers], *[pa.array([c], pa.binary()) for c in columns]], ["block", "words", "tokens", "codes", "counts", "ids"])

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pending = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, blocks, codes = (batch.column(c) for c in ("ids", "blocks", "codes"))
            count = np.repeat(ids.value_lengths().to_numpy(), places := blocks.value_lengths().to_numpy())
            starts = np.cumsum(ids.value_lengths().to_numpy()) - ids.value_lengths().to_numpy()
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) + np.repeat(np.repeat(starts, places) - ends + count, count)
            words.append((blocks.flatten().to_numpy(), codes.flatten().to_numpy(), count, ids.flatten().to_numpy()[at]))
            pending += len(count)
            if pending >= PENDING:
                yield from packed(words)
                words, pending = [], 0
        if words:
            yield from packed(words)

    return own.mapInArrow(by_block, "block bigint, words bigint, tokens bigint, codes binary, counts binary, ids binary")


# --- documents -----------------------------------------------------------------------------------------------------


def _by_document(docs: DataFrame, ranks: dict[bytes, int], schema: str, made: Callable[[pa.Array, Iterator[tuple[np.ndarray, bytes]]], pa.Table]) -> DataFrame:
    """made(doc_ids, (ids, bytes of its words) of each) is called for some documents at a time."""
    blocks = cut(docs)
    codes = blocks.filter("codes is not null").select("block", "doc_ids", "sizes", "codes")
    pieces = {rank: piece for piece, rank in ranks.items()}
    kind = "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        codes = np.concatenate([np.zeros(0, np.int32), *[np.cumsum(_unpacked(r["codes"], r["words"]), dtype=np.int32) for r in rows]])
        counts = np.concatenate([np.zeros(0, np.int64), *[_unpacked(r["counts"], r["words"]) for r in rows]])
        wide = np.dtype(kind).itemsize
        flat = np.concatenate([np.zeros(0, kind), *[np.frombuffer(pa.decompress(r["ids"], wide * r["tokens"], "zstd", asbytes=True), kind) for r in rows]]).astype("<i4")
        order = np.argsort(codes)
        starts = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        raw = [pieces[i] for i in flat.tolist()]
        words = [b"".join(raw[a : a + n]) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]

        def of(sizes: list[int], own: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
            at = 0
            for n in sizes:
                mine = own[at : at + n]
                many = counts[mine]
                ends = np.cumsum(many)
                total = int(ends[-1]) if n else 0
                yield flat[np.arange(total) + np.repeat(starts[mine] - ends + many, many)], b"".join([words[c] for c in mine.tolist()])
                at += n

        tables = []
        for k in range(left.num_rows):
            sizes = left.column("sizes")[k].as_py()
            tables.append(made(left.column("doc_ids")[k].values, of(sizes, _unpacked(left.column("codes")[k].as_py(), sum(sizes)))))
        return pa.concat_tables(tables)

    words = encoded_words(blocks, ranks)
    return codes.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(joined, schema)


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and ids of each document."""

    def made(doc_ids: pa.Array, found: Iterator[tuple[np.ndarray, bytes]]) -> pa.Table:
        return pa.table({"doc_id": doc_ids, "ids": pa.array([ids for ids, _ in found], pa.list_(pa.int32()))})

    return _by_document(docs, ranks_of(ranks_path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", made)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of each row's ids; bytes that are no UTF-8 are replaced."""
    return tokens.select("doc_id", F.decode(decoded(F.col("ids"), ranks_of(ranks_path)), "UTF-8").alias("text"))


def byte_bpe(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""

    def made(doc_ids: pa.Array, found: Iterator[tuple[np.ndarray, bytes]]) -> pa.Table:
        own = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()) for ids, raw in found]
        n, ids_hash, raw_hash = zip(*own, strict=True) if own else ((), (), ())
        return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(raw_hash, pa.string())})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _by_document(docs, ranks_of(ranks_path), schema, made)
