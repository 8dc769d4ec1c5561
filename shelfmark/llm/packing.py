"""Operator 1, packing: concatenate and cut.

Pass one turns every text into token ids once, writes them to a staged table and notes each document's place among the
tokens of its partition. The partition totals, one row a partition, are summed up in order: that gives each partition,
and so each document, its place in the one long run of all tokens. Pass two cuts the run into windows of fixed length;
a document that lies across a window's edge becomes several pieces, the boundary records. Only the last window is
padded, unless its length happens to be a power of two.

A string that the tokenizer's file lists as an added token has that token's id, as `tokenizers` gives it by default.
Null and empty texts have the end id alone. Repeated rows and equal or null ids are packed as rows of their own.
An empty table gives no pieces. Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, prepare, staged, texts_of

SEQUENCE = 1024
END_ID = 0
#: Distinct chunks whose ids a Python worker remembers; beyond it the memory starts afresh.
REMEMBERED = 900_000

#: White space as the tokenizer's own split pattern understands it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_RUN = re.compile(f"[{_WS}] ")
_SIGNS = frozenset(".,;:!?|$%&*#-")

#: The split pattern of byte-level tokenizers of this family (fixed value, as the `tokenizers` library has it).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_ranks(config: dict) -> dict[bytes, int] | None:
    """Ranks of the vocabulary of a byte-level BPE file whose ids rise in the order of its merges, else None."""
    model, pre = config["model"], config.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or config.get("normalizer"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    as_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)):
        return None
    special = {x["content"] for x in config.get("added_tokens", [])}
    return {bytes(as_byte[c] for c in t): i for t, i in vocab.items() if t not in special}


class ChunkEncoder:
    """Token ids of whole texts, by way of chunks.

    A byte-level tokenizer's split pattern never joins a character that isn't white space to white space after it. So a
    text may be cut before every run of white space, and each chunk (a run of white space and what follows up to the next)
    has the same ids as within the text. Chunks repeat, so their ids are remembered. A chunk not seen before costs the
    `tokenizers` library some 16 microseconds; where the file's ids rise with its merges, its vocabulary is handed to
    `tiktoken`, which gives the same ids at a fifth of that. Any other file is left to `tokenizers`.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        ranks, added = _byte_ranks(config), config.get("added_tokens", [])
        #: Strings that the file gives an id of their own; a text that holds one is left to `tokenizers` whole.
        self.special = re.compile("|".join(re.escape(x["content"]) for x in added) or "(?!)")
        self.path, self.tokenizer = path, None
        if ranks:
            import tiktoken

            size = max([*ranks.values(), *(x["id"] for x in added)]) + 1
            core = tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
            piece, whole = core.encode_single_piece, core.encode_ordinary

            def encode(chunk: str) -> list[int]:
                word = chunk[1:] if chunk[:1] == " " else chunk
                if word.isalpha():  # one piece of the split pattern
                    return piece(chunk.encode())
                if word[-1:] in _SIGNS and word[:-1].isalpha():  # two pieces
                    return piece(chunk[:-1].encode()) + piece(chunk[-1:].encode())
                return whole(chunk)

            self.encode = encode
        else:
            from tokenizers import Tokenizer

            size = Tokenizer.from_file(path).get_vocab_size()
            self.encode = self._whole
        self.code = "H" if size <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # of chunks that begin with one space, by what follows it

    def _whole(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        if self.tokenizer is None:
            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, known: dict[str, bytes], chunks: list[str], lead: str) -> bytes:
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            for c in chunks:
                if c not in known:
                    known[c] = array(self.code, self.encode(lead + c)).tobytes()
            return b"".join([known[c] for c in chunks])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.plain) + len(self.spaced) > REMEMBERED:
            self.plain.clear()
            self.spaced.clear()
        out = []
        for text in texts:
            if self.special.search(text):
                out.append(array(self.code, self._whole(text)).tobytes())
            elif _RUN.search(text):
                out.append(self._ids(self.plain, _CHUNK.findall(text), ""))
            else:  # each space begins a run of its own
                first, *rest = text.split(" ")
                out.append(self._ids(self.plain, _CHUNK.findall(first), "") + self._ids(self.spaced, rest, " "))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Staged rows (doc_id, part, place, tokens, ids): ids as packed little-endian numbers, the end id last; place: tokens before it in its part."""
    prepare(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, place = encoder(tokenizer_path), 0
        end = array(encode_texts.code, [END_ID]).tobytes()
        for part, _, batch in numbered(batches):
            texts = texts_of(batch)
            for at in range(0, len(texts), 512):
                ids = [x + end for x in encode_texts(texts[at : at + 512])]
                n = np.array([len(x) // encode_texts.width for x in ids], np.int64)
                ends = np.cumsum(n) + place
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + 512], pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "place", "tokens", "ids"],
                )
                place = int(ends[-1]) if len(ends) else place

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return staged(docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {doc_type}, part int, place bigint, tokens bigint, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids, if wanted)."""
    tokens = tokenized(docs, tokenizer_path)
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))  # a row a partition
    placed = tokens.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("place")).alias("at"), "tokens", "ids")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            at, n = (batch.column(c).to_numpy() for c in ("at", "tokens"))
            first = at // sequence
            pieces = (at + n - 1) // sequence - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] + nth
            begin = np.maximum(seq * sequence, at[row])
            stop = np.minimum((seq + 1) * sequence, (at + n)[row])
            start, length = begin - at[row], stop - begin
            crc, ids, own, last = np.empty(len(row), np.int64), [], None, -1
            for k, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != last:
                    raw, last = batch.column("ids")[r].as_py(), r
                    own = np.frombuffer(raw, f"<u{len(raw) // int(n[r])}").astype("<u4")
                crc[k] = zlib.crc32(own[s : s + m])
                if with_ids:
                    ids.append(own[s : s + m].astype(np.int32))
            columns = [doc_ids.take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], seq, begin - seq * sequence))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(cut, schema)
