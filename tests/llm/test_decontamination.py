import random
import time

import numpy as np
import pyarrow as pa
from shelfmark.llm import decontamination as D

WORDS = "the of and thing water house straße éa in on tion wher ond reat".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def edited(rng, text, share):
    out = list(text)
    for _ in range(int(share * len(text))):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind > 0)] = rng.choice("aeiou ") if kind < 2 else ""
    return "".join(out)


def nearest(item, text):
    """Least edit distance of item to a substring of text, by the plain table."""
    fold = lambda s: " ".join("".join(c.lower() if len(c.lower()) == 1 else c for c in s).split())
    item, text = fold(item), fold(text)
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        new = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        full = np.concatenate([[i], new])
        row = np.minimum.accumulate(full - np.arange(len(full))) + np.arange(len(full))
    return int(row.min()), len(item)


def test_against_plain_edit_distance(spark):
    rng = random.Random(8)
    items = [(k, passage(rng, 20)) for k in range(12)] + [(12, "Short one, though."), (13, None), (14, " \n"), (15, ""), (3, passage(rng, 9))]
    rows = []
    for k in range(60):
        text = passage(rng, 60)
        if k % 2:
            text += "\n" + edited(rng, items[k % 13][1], (0, 0, 0.04, 0.08)[k // 2 % 4]).replace(" ", "  ") + "\t" + passage(rng, 30)
        rows.append((k, text, "x"))
    rows += [(None, None, "x"), (5, "", "x"), (5, rows[1][1], "y"), (70, items[12][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = set()
    for i, text, _ in rows:
        for item, own in items:
            if own and own.strip() and text:
                d, n = nearest(own, text)
                if d <= int(D.MOST_EDITS * n + 1e-9):
                    expected.add((i, item, d))
    out = D.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in out} == expected
    folded = {(i, t) for i, t, _ in rows}
    for r in out:
        if r.distance == 0:
            texts = [t for i, t in folded if i == r.doc_id and t]
            assert any(nearest(own, t[r.start : r.end])[0] == 0 for t in texts for item, own in items if item == r.item_id and own)
    assert {(r.doc_id, r.item_id, r.distance) for r in D.leaks(docs, bench, block_items=4).collect()} == expected
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(str(r) for r in rows if not any(e[0] == r[0] for e in expected) or r[1] == "")


def test_recall_of_the_search():
    rng = random.Random(9)
    items = [(k, passage(rng, 18)) for k in range(60)]
    index = D.Items(items)
    found = within = 0
    for k, own in items:
        for share in (0.05, 0.1):
            text = passage(rng, 40) + " " + edited(rng, own, share) + " " + passage(rng, 40)
            if nearest(own, text)[0] <= D.MOST_EDITS * len(own):
                within += 1
                ((_, _, chars, at, _),) = list(D.normalized(pa.array([text])))
                found += (0, k) in index.matches(chars, at)
    assert within > 100 and found >= 0.95 * within


def recall(length, share, seed, n=50):
    rng = random.Random(seed)
    items = [(k, passage(rng, length)[:length].strip()) for k in range(n)]
    index = D.Items(items)
    found = within = 0
    for k, own in items:
        text = passage(rng, 20) + " " + edited(rng, own, share) + " " + passage(rng, 20)
        if nearest(own, text)[0] <= int(D.MOST_EDITS * nearest(own, own)[1] + 1e-9):
            within += 1
            ((_, _, chars, at, _),) = list(D.normalized(pa.array([text])))
            found += (0, k) in index.matches(chars, at)
    assert within > 0.9 * n
    return found / within


def test_recall_by_length_up_to_the_threshold():
    least = {20: 0.88, 30: 0.95, 45: 0.95, 60: 0.95, 79: 0.95, 100: 0.95, 150: 0.95, 300: 0.98}
    for length, floor in least.items():
        got = [recall(length, share, length) for share in (0.05, 0.1, 0.15, 0.2)]
        assert min(got) >= floor, (length, got)


def test_recall_of_short_middling_and_long_items_up_to_the_threshold():
    """Items of 4, 12 and 40 random words, and of Chinese characters, with edits up to the threshold."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda rng: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 10)))
    chinese = lambda rng, n: "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n))
    makers = [(lambda rng, n=n: " ".join(word(rng) for _ in range(n)), " ") for n in (4, 12, 40)] + [(lambda rng, n=n: chinese(rng, n), "") for n in (12, 40, 120)]
    for make, gap in makers:
        rng = random.Random(2)
        items = [(k, make(rng)) for k in range(60)]
        index = D.Items(items)
        for share in (0.05, 0.1, 0.15, 0.2):
            found = within = 0
            for k, own in items:
                text = make(rng) + gap + edited(rng, own, share) + gap + make(rng)
                if nearest(own, text)[0] <= int(D.MOST_EDITS * len(own) + 1e-9):
                    within += 1
                    ((_, _, chars, at, _),) = list(D.normalized(pa.array([text])))
                    found += (0, k) in index.matches(chars, at)
            assert within > 50 and found >= 0.95 * within, (items[0], share, found, within)


def test_items_that_share_an_opening():
    opening = "question: which of the following sentences is the right answer to what was asked above, "
    rng = random.Random(3)
    index = D.Items([(k, opening + passage(rng, 12)) for k in range(2000)])
    index.matches(*list(D.normalized(pa.array(["some text"])))[0][2:4])
    ((_, _, chars, at, _),) = list(D.normalized(pa.array([opening + passage(rng, 30), index_text(index, 77) + " and more"])))
    began = time.process_time()
    found = index.matches(chars, at)
    assert set(found) == {(1, 77)} and time.process_time() - began < 5


def index_text(index, item):
    return "".join(map(chr, index.text[item].tolist()))


def test_items_inside_text_without_spaces():
    rng = random.Random(11)
    letters = {"chinese": [chr(c) for c in range(0x4E00, 0x5200)], "thai": [chr(c) for c in range(0xE01, 0xE2F)], "base64": list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")}
    run = lambda own, n: "".join(rng.choice(own) for _ in range(n))
    for own in letters.values():
        items = [(k, run(own, n)) for k, n in enumerate((12, 30, 43, 44, 60, 90, 150, 300))]
        index = D.Items(items)
        for k, item in items:
            for text in (run(own, 57) + item + run(own, 33), "so " + run(own, 9) + edited(rng, item, 0.05) + run(own, 21) + " it is"):
                ((_, _, chars, at, _),) = list(D.normalized(pa.array([text])))
                assert (0, k) in index.matches(chars, at), (item, text)


def test_walks_inside_runs_stay_in_them():
    ((_, _, chars, at, _),) = list(D.normalized(pa.array(["ab " + "x" * 20 + " cd", "", "日本 e", "fg"])))
    assert D.walk_starts(chars, at, 1).tolist() == [0, *range(3, 23), 24, 26, 27, 29, 30]
    assert D.walk_starts(chars, at, 4).tolist() == [0, *range(3, 23, 4), 24, 26, 29, 30]


def test_distances_of_many_windows_are_those_of_one():
    rng = random.Random(4)
    items = [(k, passage(rng, 40)[: rng.randrange(1, 300)]) for k in range(30)] + [(30, "日本語の文章です"), (31, "x" * 64)]
    index = D.Items(items)
    text = " ".join(edited(rng, own, 0.2) + passage(rng, 9) for _, own in items)
    ((_, _, chars, _, _),) = list(D.normalized(pa.array([text])))
    which = np.array([rng.randrange(len(index.text)) for _ in range(150)])
    first = np.array([rng.randrange(len(chars)) for _ in which])
    last = np.minimum(len(chars), first + np.array([rng.randrange(400) for _ in which]))
    got = index._distances(which, first, last, chars)
    for k, a, b, d in zip(which, first, last, got, strict=True):
        assert d == D._scan(index.mask(k), len(index.text[k]), chars[a:b].tolist(), False)[0]


def test_walks_of_equal_strings_are_equal_and_end_at_the_window():
    plan, seed = D.PLANS[0], D.PLANS[0].seeds[0]
    symbols = D._symbols(np.array([ord(c) for c in "abcdefgh" * 12], np.uint32), seed)
    a, b = (D.walk(symbols, np.array([s]), 0, plan.steps, plan)[-1] for s in (0, 8))
    assert a == b
    short = D._symbols(np.array([ord(c) for c in "xyz"], np.uint32), seed)
    long = D._symbols(np.array([ord(c) for c in "xyz and more text that goes on and on and on"], np.uint32), seed)
    assert D.walk(short, np.array([0]), 0, 3, plan)[-1] == D.walk(long, np.array([0]), 0, 3, plan)[-1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.leaks(docs, none).count() == 0 and D.clean(docs, none).count() == 1
    assert D.leaks(docs.limit(0), none).count() == 0


def test_clean_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "abc", "u", 2.5), (2, None, "v", None)], "doc_id bigint, text string, `q``u.o te` string, item_id double")
    bench = spark.createDataFrame([(1, "something else that is longer")], "item_id bigint, text string")
    out = D.clean(docs, bench)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "abc", "u", 2.5), (2, None, "v", None)]


def test_distances_of_many_windows_at_a_time():
    """Windows of every size, items of one block to six together, and columns laid out in several pieces."""
    rng = random.Random(12)
    items = [(k, passage(rng, 60)[:n]) for k, n in enumerate((1, 2, 40, 63, 64, 65, 127, 128, 129, 200, 321, 380))]
    index = D.Items(items)
    which = [k for k in range(len(index.ids)) for _ in range(6)]
    texts = [(passage(rng, 3) + edited(rng, items[k][1], rng.random() / 3) + passage(rng, 3)).lower()[: rng.randrange(1, 700)] for k in which]
    last = np.cumsum([len(t) for t in texts])
    chars = np.array([ord(c) for t in texts for c in t], np.uint32)
    got = index._distances(np.array(which), np.append(0, last[:-1]), last, chars)
    folded = ["".join(map(chr, index.text[k])) for k in which]
    for item, text, distance in zip(folded, texts, got.tolist(), strict=True):
        row = np.zeros(len(text) + 1, int)
        codes = np.array([ord(c) for c in text])
        for i, c in enumerate(item, 1):
            full = np.concatenate([[i], np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)])
            row = np.minimum.accumulate(full - np.arange(len(full))) + np.arange(len(full))
        assert distance == row.min(), (item, text)


def test_plans_share_the_paths_of_their_seeds():
    """Two plans whose repetitions have the same seeds read each step of the texts once."""
    rng = random.Random(13)
    index = D.Items([(0, passage(rng, 12)[:100]), (1, passage(rng, 30)[:200])])
    made = []
    path = D.Path

    class Counted(path):
        def __init__(self, *args):
            made.append(1)
            super().__init__(*args)

    D.Path = Counted
    try:
        assert (0, 1) in index.search(pa.array([passage(rng, 20) + " " + "".join(map(chr, index.text[1]))]))
    finally:
        D.Path = path
    assert len(made) == max(plan.repetitions for plan in D.PLANS[:2]) < len(index.walks)


def windows_around(rng, items, share, n):
    """(text, item, characters, places) of n windows, some with an item edited by so much in them, each again half an item on."""
    out = []
    for text in range(n):
        k = rng.randrange(len(items))
        own = edited(rng, items[k][1], rng.choice(share)) if share else passage(rng, 30)
        ((_, _, chars, _, place),) = list(D.normalized(pa.array([passage(rng, 3) + " " + own + " " + passage(rng, 3)])))
        room = 32 + int(1.4 * len(items[k][1]))
        for first in (0, 32):
            if len(chars[first : first + room]):
                out.append((text, k, chars[first : first + room], place[:-1][first : first + room]))
    return out


def test_openings_lose_no_window_that_holds_its_item():
    rng = random.Random(15)
    items = [(k, passage(rng, 60)[:n].strip()) for k, n in enumerate((12, 60, 64, 65, 100, 159, 161, 230, 320, 390))]
    index = D.Items(items)
    waiting = windows_around(rng, items, (0, 0.1, 0.18, 0.22, 0.3, 0.6), 300)
    near = index._near(waiting, D.MOST_EDITS)
    within = [D._scan(index.mask(k), len(index.text[k]), chars.tolist(), False)[0] <= int(D.MOST_EDITS * len(index.text[k]) + 1e-9) for _, k, chars, _ in waiting]
    assert 100 < sum(within) < len(within) - 100 and near.tolist() == within


def test_windows_that_hold_no_item_are_left_after_its_opening():
    """Of windows without their item only the opening's blocks of 64 characters are compared, in overlapping windows once."""
    rng = random.Random(16)
    items = [(k, passage(rng, 60)[:300]) for k in range(20)]
    index = D.Items(items)
    waiting = windows_around(rng, items, (), 200)
    compared = []
    distances = index._distances

    def counted(which, first, last, chars, *sizes):
        compared.append(int((((sizes or (index.sizes,))[0][which] + 63) // 64 * (last - first)).sum()))
        return distances(which, first, last, chars, *sizes)

    index._distances = counted
    out = {}
    index._verify(list(waiting), D.MOST_EDITS, out)
    whole = sum((int(index.sizes[k]) + 63) // 64 * len(chars) for _, k, chars, _ in waiting)
    assert not out and 0 < sum(compared) < 0.4 * whole
