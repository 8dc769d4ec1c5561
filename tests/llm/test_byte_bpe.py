import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfmark.llm import byte_bpe
from shelfmark.llm.queries import ranks_path

ODD = [None, "", " ", "  a  b\n\n c\t\tx \x1c!\x1c b", "a\x85b \xa0 c", "\n", "it's  the 'll  x 'S", "<|endoftext|> hi", "日本語 テスト 🎉🎉 x", "x \n y ", "é ؀\U0002ebf0\U0003fc3f2½Ⅷ՘\U00011de0 x", "￾￿\x00 a"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(ranks_path()), special_tokens={})
    return own.encode_ordinary


def row(ids, text):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_documents(spark, library, monkeypatch):
    drawn = random.Random(3)
    texts = ODD + ["".join(drawn.choices(" abcdeéß1.,'\n", k=drawn.randrange(400))) for _ in range(60)] + ["the cat sat " * 2000, ODD[8]]
    rows = [(None if k % 17 == 3 else k % 40, t, k, "w") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, code int, words string").repartition(3)
    want = sorted((str(r[0]), *row(library(r[1] or ""), r[1])) for r in rows)
    out = byte_bpe.byte_bpe(docs, ranks_path())
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == want
    monkeypatch.setattr(byte_bpe, "SLICE", 5)
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 200)  # several blocks a task
    monkeypatch.setattr(byte_bpe, "GROUPS", 7)
    assert sorted((str(r[0]), *r[1:]) for r in byte_bpe.byte_bpe(docs, ranks_path()).collect()) == want


def test_round_trip(spark):
    rows = [(k, t or "") for k, t in enumerate(ODD)]
    ids = byte_bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), ranks_path())
    assert sorted(map(tuple, byte_bpe.decode(ids, ranks_path()).collect())) == rows


def test_words_of_every_length(spark, library):
    drawn = random.Random(5)
    words = ["".join(drawn.choices(letters, k=n)) for letters in ("ab", "etaoinshrdlu", "éß日本e") for n in (1, 2, 3, 7, 30, 84, 85, 86, 255, 256, 257, 400, 900)]
    words += ["a" * n for n in (255, 256, 257, 258, 511, 1000, 30_001)] + ["=" * 5000, " " * 3000]
    df = spark.createDataFrame([(w, w.encode()) for w in words], "text string, w binary")
    began = time.time()
    out = df.select("text", byte_bpe.word_ids(F.col("w"), byte_bpe.ranks_of(ranks_path())).alias("ids")).collect()
    assert time.time() - began < 90
    for r in out:
        assert r.ids == library(r.text), r.text[:50]


def test_every_piece_is_the_merge_of_its_bytes(library):
    """What merging all pairs of a rank at once rests on."""
    import tiktoken

    ranks = byte_bpe.ranks_of(ranks_path())
    core = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    for piece, rank in ranks.items():
        assert core.encode_single_piece(piece) == [rank]
        if len(piece) > 1:  # and its last merge joins two pieces of lower rank, each the merge of its bytes
            assert any(max(ranks.get(piece[:k], rank), ranks.get(piece[k:], rank)) < rank for k in range(1, len(piece)))


def test_empty_table(spark):
    assert byte_bpe.byte_bpe(spark.createDataFrame([], "doc_id string, text string"), ranks_path()).count() == 0
