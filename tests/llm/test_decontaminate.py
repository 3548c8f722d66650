import random

import numpy as np
import pytest

from lectern.llm import decontaminate
from tests.llm import brute


def _plain(text):
    return brute.words("".join(" " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c.lower() if c.isascii() else c for c in text or ""))


def _score(a, b):
    """Smith-Waterman cell by cell."""
    before, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        best = max(best, *row)
        before = row
    return best


def _held(item, text):
    """The share of the item's full score that alignment alone finds, if it is enough. No word gains more than two."""
    present = set(text)
    if 2 * sum(w in present for w in item) < _least(item) or (s := _score(item, text)) < _least(item):
        return None
    return min(1.0, s / (2 * min(len(item), 50)))


def _least(words):
    full = 2 * min(len(words), 50)
    return max(0.4 * full, min(full, 6))


EDITS = {
    "every third word replaced": lambda w, rnd: [x if i % 3 else f"r{i}" for i, x in enumerate(w)],
    "every third word left out": lambda w, rnd: [x for i, x in enumerate(w) if i % 3],
    "every fourth and fifth word left out": lambda w, rnd: [x for i, x in enumerate(w) if i % 5 > 1],
    "a foreign word behind every second": lambda w, rnd: [y for i, x in enumerate(w) for y in ([x, f"p{i}"] if i % 2 else [x])],
    "a foreign word behind every word": lambda w, rnd: [y for i, x in enumerate(w) for y in (x, f"p{i}")],
    "a third replaced at random": lambda w, rnd: [f"r{i}" if rnd.random() < 1 / 3 else x for i, x in enumerate(w)],
    "a half replaced at random": lambda w, rnd: [f"r{i}" if rnd.random() < 1 / 2 else x for i, x in enumerate(w)],
    "a third left out at random": lambda w, rnd: [x for x in w if rnd.random() > 1 / 3],
    "some neighbours swapped": lambda w, rnd: [x for i in range(0, len(w), 2) for x in w[i : i + 2][:: -1 if i % 6 == 0 else 1]],
}


@pytest.mark.parametrize("edit", EDITS)
def test_every_copy_that_alignment_alone_accepts_is_found(spark, sf_dir, edit):
    rnd = random.Random(edit)
    items = {r.item_id: _plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    filler = [w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200).collect() for w in _plain(r.text)][:20_000]
    docs, want = [], {}
    for i, words in items.items():
        passage = EDITS[edit](words, rnd)
        a = rnd.randrange(len(filler) - 200)
        text = filler[a : a + 60] + passage + filler[a + 60 : a + 120]
        docs.append((i, " ".join(text)))
        for j, other in items.items():
            if (share := _held(other, text)) is not None:
                want[i, j] = share
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert found == pytest.approx(want) and len(want) > 0


def test_random_items_of_few_different_words(spark):
    rnd = random.Random(11)
    vocabulary = [f"v{i}" for i in range(60)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: draw(rnd.choice([1, 2, 3, 4, 5, 6, 8, 11, 15, 20, 60, 120])) for i in range(40)}
    texts = {}
    for d in range(150):
        words = items[rnd.randrange(40)]
        a = rnd.randrange(len(words))
        some = [w for w in words[a : a + rnd.randrange(5, 80)] if rnd.random() < 0.8]
        texts[d] = draw(rnd.randrange(30)) + [y for w in some for y in ([w] if rnd.random() < 0.7 else [w, "other"])] + draw(rnd.randrange(30))
    want = {(d, i): share for d, t in texts.items() for i, w in items.items() if (share := _held(w, t)) is not None}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, tests).collect()}
    assert found == pytest.approx(want) and {len(items[i]) for _, i in want} >= {1, 2, 3, 4}


def test_alignment_equals_the_plain_one():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(1, 14))] for _ in range(2))
        score, first, last = decontaminate.align(np.array(a), np.array(b))
        assert score == _score(a, b)
        if score:
            assert _score(a, b[first : last + 1]) == score


@pytest.mark.parametrize("block_words", [2_000_000, 300])
def test_whole_table_against_all_pairs(spark, small_dir, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    docs, items = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    if block_words == 300:
        found = {(r.doc_id, h.item_id): h.score for f in decontaminate.item_finders(docs, items, block_words=300)
                 for r in docs.select("doc_id", f("text").alias("h")).collect() for h in r.h}
    else:
        found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, items).collect()}
    want = {}
    texts = [(r.doc_id, _plain(r.text)) for r in docs.collect()]
    for item in items.collect():
        words = _plain(item.text)
        for doc, text in texts:
            if (share := _held(words, text)) is not None:
                want[doc, item.item_id] = share
    assert found == pytest.approx(want) and want


def test_edited_copies_and_edges(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    item = [rnd.choice(vocabulary) for _ in range(40)]
    long_item = [rnd.choice(vocabulary) for _ in range(900)]
    filler = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    edited = [w if i % 5 else "other" for i, w in enumerate(item)]
    cut = [w for i, w in enumerate(item) if i % 6]
    rows = {
        0: filler(300),
        1: filler(100) + item + filler(100),
        2: filler(9000) + edited + filler(50),
        3: cut,
        4: [w.upper() + "," for w in item],
        5: filler(200) + long_item[300:360] + filler(100),
        6: item[:8] + filler(100),
        7: item * 50,
    }
    docs = [(i, " ".join(w), "own", 1.0) for i, w in rows.items()] + [(8, None, "own", 1.0), (9, "", "own", 1.0), (None, " ".join(item), "own", 1.0)]
    docs.append(docs[1])
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, score double")
    tests = [(70, " ".join(item)), (71, " ".join(long_item)), (72, None), (73, ""), (74, "two words"), (70, " ".join(item))]
    tests = spark.createDataFrame(tests, "item_id bigint, text string")
    found = decontaminate.contaminated(docs, tests).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == [
        ("1", 70), ("1", 70), ("2", 70), ("3", 70), ("4", 70), ("5", 71), ("7", 70), ("None", 70)
    ]
    exact = next(r for r in found if r.doc_id == 1)
    assert (exact.score, exact.first_word, exact.last_word) == (1.0, 100, 139)
    kept = decontaminate.without_contaminated(docs, tests)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 6, 8, 9]
    assert decontaminate.contaminated(docs.limit(0), tests).count() == 0
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0
