import random

import corpus_pipeline
import numpy as np
import pytest
from shelfmark.llm.queries import tokenizer_path

LANG = {"en": "the of and thing with water house".split(), "de": "der und nicht für straße öl haus".split()}
COMMON = "Share this page with all of your friends"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = lambda lang, n: " ".join(rng.choice(LANG[lang]) + rng.choice(("", "ing", "en", "s")) + str(rng.randrange(99)) for _ in range(n))
    items = [(k, " ".join(rng.choice(LANG["en"]) + rng.choice(("al", "ic", "ous")) for _ in range(25))) for k in range(4)]
    rows = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        text = words(lang, 60)
        if k % 4 == 0:
            text += f"\n{COMMON}"
        if k % 10 == 7:
            text += "\n" + items[k % 4][1]
        rows.append((k, text, lang))
    rows += [(100, rows[1][1], "en"), (101, rows[2][1].replace("thing", "things", 1), "en"), (102, "12345 !!", "en"), (103, None, "de"), (104, "", None)]
    at = f"file://{tmp_path_factory.mktemp('docs')}"
    docs = [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def test_each_stage_on_what_its_predecessor_kept(spark, folder):
    at, rows, items = folder
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, at)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
            docs = corpus_pipeline.staged(docs, name)
            kept.append({r.doc_id: r.text for r in docs.collect()})
    text = dict((i, t) for i, t, _ in rows)
    assert set(kept[0]) == set(text) - {102, 103, 104}
    assert kept[1] == {i: "\n".join(x for x in text[i].split("\n") if x != COMMON) for i in kept[0]}
    assert set(kept[2]) == set(kept[1]) - {100, 101}
    assert set(kept[3]) == {i for i in kept[2] if not any(own in kept[2][i] for _, own in items)} and len(kept[3]) < len(kept[2])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = docs.toPandas()
    total = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept[3].items()}
    assert dict(pieces.groupby("doc_id")["length"].sum()) == total
    assert np.array_equal(np.sort(pieces["sequence_id"] * 1024 + pieces["offset"]), np.sort(np.cumsum(pieces.sort_values(["sequence_id", "offset"])["length"]) - pieces.sort_values(["sequence_id", "offset"])["length"]))
    whole = corpus_pipeline.run(spark, at).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert {d: n for d, n, s in zip(whole["doc_id"], whole["doc_tokens"], whole["start"], strict=True) if s == 0} == total
    assert set(key) <= set(whole.columns)
