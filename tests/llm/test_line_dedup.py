import hashlib
import time
from collections import Counter

from shelfmark.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(texts, min_docs):
    split = [("" if t is None else t).split("\n") for t in texts]
    found = Counter(k for own in split for k in {key(x) for x in own} if k)
    kept = [[x for x in own if found[key(x)] < min_docs] for own in split]
    return sorted((len(a), len(a) - len(b), hashlib.sha256("\n".join(b).encode()).hexdigest()) for a, b in zip(split, kept, strict=True))


TEXTS = [None, "", "\n\n", "A b\n\x0bÉa \r\nx", "a B\t\nÉA\nx\nx", "a b\néa", "É\nKK\n", "kK\né"] + ["hot\nown%d\nHOT" % k for k in range(40)]


def test_against_brute_force(spark):
    rows = [(k % 30 if k % 7 else None, t, 1, "z") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, a int, lines string").repartition(3)
    for min_docs, batches, fanout in ((2, 4, 2), (3, 5, 3), (10, 1, 2)):
        out = line_dedup.line_dedup(docs, min_docs=min_docs, batches=batches, fanout=fanout).collect()
        assert sorted((r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == brute(TEXTS, min_docs)


def test_texts_and_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb", 3, "batch"), (2, "A \nc", 4, None)], "doc_id bigint, text string, n_chars bigint, batch string")
    out = line_dedup.deduplicated(docs, min_docs=2)
    assert out.columns == docs.columns
    assert sorted(out.collect()) == [(1, "b", 1, "batch"), (2, "c", 1, None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.line_dedup(docs).count() == 0


CLASHING = ["row_file", "row_index", "row", "lines", "all", "gone", "own", "n_lines", "a", "b", "batch", "docs", "x", "pos", "line", "all_lines", "q`u.o te"]


def test_no_name_of_a_column_clashes(spark):
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASHING)
    rows = [(k, f"own {k}\nshared", *(f"{c} {k}" for c in CLASHING)) for k in range(4)]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, schema), min_docs=3)
    assert out.columns == ["doc_id", "text", *CLASHING]
    assert sorted(map(tuple, out.collect())) == [(r[0], r[1].split("\n")[0], *r[2:]) for r in rows]


def test_documents_of_many_common_lines(spark):
    common = [f"common {k}" for k in range(30_000)]
    texts = ["\n".join([*common[k:], f"own {k}", *common[:k], "x"]) for k in range(0, 10)] + ["\n".join(common), "nothing\ncommon 7", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    began = time.time()
    out = line_dedup.line_dedup(docs).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == brute(texts, 10)
    assert time.time() - began < 60
