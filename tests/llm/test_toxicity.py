import itertools
import zlib

import numpy as np
import pytest

from lectern.llm import toxicity


def _weight_by_hand(word, weights):
    """The sum over all triples of places, as the kernel defines it."""
    codes = [27, *(ord(c) - 96 for c in word), 27]
    total = 0.0
    for at in itertools.combinations(range(len(codes)), 3):
        if all(b - a <= 3 for a, b in zip(at, at[1:])):
            number = 0
            for i in at:
                number = number * 28 + codes[i]
            total += weights[number] * 0.5 ** (at[-1] - at[0] - 2)
    return total / np.sqrt(len(word) + 1)


def test_scores_equal_sums_by_hand():
    weights = np.random.default_rng(0).normal(size=toxicity.FEATURES)
    texts = ["one two three", "", "supercalifragilistic  a\nb", "Ünïcode straße", "i d i o t here", "st.up-id", "漢字 only", "x"]
    words = [["one", "two", "three"], [], ["supercalifragilistic", "ab"], ["unicode", "strae"], ["idiot", "here"], ["stupid"], ["only"], ["x"]]
    want = [max([0.0, *(_weight_by_hand(w, weights) for w in ws)]) for ws in words]
    assert toxicity.text_scores(texts, weights) == pytest.approx(want)


def test_folded_weights_equal_kernel_expansion():
    words, landmarks = ["idiot", "water", "stupid"], ["idiot", "house"]
    k = toxicity.kernel(words, landmarks)
    for j, landmark in enumerate(landmarks):
        row, which, weight = toxicity._maps([landmark])
        folded = np.bincount(which, weights=weight, minlength=toxicity.FEATURES)
        assert toxicity._scores(words, folded) == pytest.approx(k[:, j], rel=1e-5)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_texts(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    blamed = [r.predicted for r in rows if r.toxic == 0]
    # The insults of one language are made of ordinary syllables here; on the larger check tables 717 of 718 are caught.
    assert sum(caught) >= 0.65 * len(caught)
    assert sum(blamed) <= 0.02 * len(blamed)
    again = {r.doc_id: r.score for r in toxicity.score_texts(docs, labels).limit(50).collect()}
    assert all(0 <= s <= 1 for s in again.values())
    model = toxicity.train(docs, labels)
    odd = ["you l.o.s.e.r", "what an idxiot", "a m o r o n", "nothing wrong here at all", ""]
    assert (model.texts(odd) >= 0.7).tolist() == [True, True, True, False, False]


def test_nulls_fold_and_clashing_columns(spark):
    rows = [(i, "all is well in words " + str(i) if i % 2 else f"you are scumbag number {i}", 5.0, "s") for i in range(60)]
    rows += [(None, "you are scumbag", 5.0, "s"), (60, None, 5.0, "s"), (61, "", 5.0, "s"), (62, "scumbag " * 50_000, 5.0, "s"), (1, rows[1][1], 5.0, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(None, 1, 1), (3, None, 0), (5, 1, 0)], "doc_id bigint, toxic int, quality int")
    got = toxicity.score_texts(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by_id = {r.doc_id: r for r in got}
    assert by_id[62].predicted == by_id[None].predicted == 1
    assert by_id[60].score == by_id[61].score < 0.5
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("text like '%scumbag%'").count() == 0
    assert toxicity.score_texts(docs.limit(0), labels).count() == 0
    none = toxicity.score_texts(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_texts_in_other_scripts_are_learnt_and_found():
    rnd = np.random.default_rng(3)
    for letters, insults in (("абвгдежзиклмнопрстуфхцчшыьэюя", ["дурачина", "мерзавец"]), ("αβγδεζηθικλμνξοπρστυφχψω", ["ηλιθιος", "βλακεντιος"]), ("ابتثجحدرزسشصطعغفقكلمنهوي", ["احمقجدا", "غبيتماما"])):
        ordinary = ["".join(rnd.choice(list(letters), rnd.integers(3, 9))) for _ in range(400)]
        texts = [" ".join(rnd.choice(ordinary, 30)) for _ in range(600)]
        toxic = np.arange(600) % 3 == 0
        texts = [f"{t} {insults[i % 2]} {ordinary[i % 400]}" if toxic[i] else t for i, t in enumerate(texts)]
        words = toxicity.word_list(texts)
        weights = toxicity.learn_weights([words[i] for i in range(300) if toxic[i]], [words[i] for i in range(300) if not toxic[i]])
        scores = toxicity.text_scores(texts[300:], weights)
        assert scores[toxic[300:]].min() > scores[~toxic[300:]].max(), insults


def test_look_alikes_and_digits_inside_words_are_read_as_letters():
    assert toxicity.word_list(["id1ot іdiоt ｉｄｉｏｔ i d i o t", "2019 5 a1 7b"]) == [["idiot"], ["a", "b"]]
    assert toxicity.word_list(["дурак"])[0] != toxicity.word_list([""])[0]


def test_insults_in_scripts_without_blanks():
    rnd = np.random.default_rng(5)
    common = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    texts = ["。".join("".join(rnd.choice(common, 12)) for _ in range(6)) for _ in range(900)]
    toxic = np.arange(900) % 3 == 0
    insults = ["傻逼", "白痴", "ばかやろう", "ไอ้โง่"]
    texts = [t[:20] + insults[i // 3 % 4] + t[20:] if toxic[i] else t for i, t in enumerate(texts)]
    words = toxicity.word_list(texts)
    weights = toxicity.learn_weights([words[i] for i in range(450) if toxic[i]], [words[i] for i in range(450) if not toxic[i]])
    scores = toxicity.text_scores(texts[450:], weights)
    limit = np.quantile(scores[~toxic[450:]], 0.99)
    assert (scores[toxic[450:]] > limit).mean() > 0.9
    assert toxicity.word_list(["白痴"])[0] and toxicity.text_scores(["白痴"], weights)[0] > limit
    assert toxicity.text_scores(["白x痴"], weights)[0] >= 0


def test_vowel_signs_tell_words_apart_and_points_do_not():
    assert toxicity.word_list(["कुत्ता"]) != toxicity.word_list(["कतत"])
    assert toxicity.word_list(["مُحَمَّد"]) == toxicity.word_list(["محمد"])


def test_a_few_wrong_labels_do_not_clear_an_insult():
    rnd = np.random.default_rng(8)
    ordinary = ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), rnd.integers(4, 9))) for _ in range(500)]
    texts = [" ".join(rnd.choice(ordinary, 30)) for _ in range(900)]
    toxic = np.arange(900) % 3 == 0
    texts = [f"{t} {['scumbag', 'halfwit'][i // 3 % 2]}" if toxic[i] else t for i, t in enumerate(texts)]
    labelled = toxic.copy()
    labelled[[0, 3, 6, 9]] = False  # four of a hundred and fifty
    words = toxicity.word_list(texts)
    weights = toxicity.learn_weights([words[i] for i in range(450) if labelled[i]], [words[i] for i in range(450) if not labelled[i]])
    scores = toxicity.text_scores(texts[450:], weights)
    assert (scores[toxic[450:]] > scores[~toxic[450:]].max()).mean() > 0.9
