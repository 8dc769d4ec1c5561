import zlib

import numpy as np
import pytest
from shelfmark.llm import packing
from shelfmark.llm.queries import tokenizer_path

ODD = ["  a  b\n\n c\t\tx \x1c!\x1c b", "a\x85b \xa0 c", "\n", "", " ", "it's  the 'll  x ", "<|endoftext|> hi", "a<|endoftext|>b  <|endoftext|><|endoftext|>\n c", "<|endoftext",  "日本語 テスト 🎉🎉 x", "x \n y", "a b\nc. d's, (e) 12a."]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def test_chunks_have_the_ids_of_the_whole_text(reference):
    texts = ODD + ["word " * 5000]
    for text, ids in zip(texts, packing.ChunkEncoder(tokenizer_path())(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == reference(text)[:-1]


def test_round_trip(spark, reference):
    rows = [(k, t, 7) for k, t in enumerate(ODD)] + [(None, None, 1), (3, "\n", 2), (3, "again", 2), (50, "the cat sat " * 2000, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(3)
    out = packing.pack(docs, tokenizer_path(), with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    out["ids"] = out["ids"].map(np.array)
    run = np.concatenate(list(out["ids"]))
    assert (out["sequence_id"] * 1024 + out["offset"]).tolist() == (np.cumsum(out["length"]) - out["length"]).tolist()  # no gap
    assert all(zlib.crc32(x.astype("<u4").tobytes()) == c for x, c in zip(out["ids"], out["ids_crc32"], strict=True))
    packed, at = [], 0
    for n, start in zip(out["doc_tokens"], out["start"], strict=True):
        if start == 0:
            packed.append((n, run[at : at + n].tolist()))
            at += n
    assert at == len(run)
    assert sorted(x for _, x in packed) == sorted(reference(t) for _, t, _ in rows)
    assert all(n == len(x) for n, x in packed)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(docs, tokenizer_path()).count() == 0
