import hashlib
import random
import re

import numpy as np
import pytest

from lectern.llm import boosting, pii
from lectern.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if ok():
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_on_random_texts():
    rnd = random.Random(6)
    parts = ["a.b", "@", "x-1.de", ".", "1.2.3.4", "255", "256", "0.", "+1 (407) 555-", "7710", " ", "-", "4111 1111 1111 1111", "é", "漢", "%", "\n", "007.", "1", "2", "+", "(", ")"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == _brute(text), text


def test_long_runs_take_one_pass():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "+1 " * 100_000, "1 " * 150_000, "a@b" + ".c" * 100_000):
        pii.base_spans(text), pii.candidates(text[:20_000])


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    added = 0
    for r in QUERIES["op1_pii"](spark, sf_dir).collect():
        base = _brute(texts.pop(r.doc_id))
        names = [f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s in names] == names
        added += len(spans) - len(names)
    assert not texts and added < 20


def test_other_formats_are_found_and_clean_texts_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    models = pii.train(docs)
    assert all(models)
    for text, kind in [("ask for (407) 555-7710 there", "phone"), ("or 407-555-7710 here", "phone"), ("it was 4539.5787.6362.1486 then", "card"),
                       ("an.e7@mail4.example.com", "email"), ("or an.e7 (at) mail4.example.com here", "email")]:
        _, spans = pii.all_spans(text, models)
        assert [pii.KINDS[k] for _, k, _ in spans] == [kind], text
    for text in ("in 1998-2003 there were 12345 items", "1,234,567.89 and 10.20.30", 'token = "681c09b8e90e7e8c9575180f595f"', "we met at noon.Then"):
        assert pii.all_spans(text, models)[1] == []
    text = "a +1 (407) 555-7710 b x@y.z c"
    assert pii.redact(text, pii.base_spans(text)) == "a [PHONE] b [EMAIL] c"


def _number(rnd):
    return f"{rnd.randint(201, 989)}", f"{rnd.randint(201, 989)}", f"{rnd.randint(0, 9999):04}"


def test_formats_more_frequent_than_base_matches_are_found(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(1200):
        a, b, c = _number(rnd)
        text = f"Write to us or call {a}-{b}-{c} on weekdays." if i % 2 else f"Our office: ({a}) {b}-{c}, or jo{i} (at) host{i % 7}.com any time."
        own = (f"Abroad +1 ({b}) {a}-{c}, mail ann{i}@post.example.org", f"Abroad or {a}{i}.lee@host.net, then +1 ({b}) {a}-{c} too")[i // 40 % 2]
        rows.append((i, f"{text} {own}" if i % 40 < 2 else f"{text} Seen in {1990 + i % 30}-{2021 + i % 9} and {c}{a}{b}."))
    models = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for _, text in rows:
        written = {m[0] for m in re.finditer(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}|(?<![0-9])[0-9]{3}-[0-9]{3}-[0-9]{4}|jo[0-9]+ \(at\) host[0-9].com", text.split(" Abroad")[0])}
        found = pii.all_spans(text, models)
        assert written == {text[a:b] for a, k, b in found[1] if (a, k, b) not in found[0]}, text


def test_rare_kinds_and_small_or_crowded_tables_have_models(spark):
    cases = (["nothing of interest"], ["1998-2003 and 20031997, " * 30 + str(i) for i in range(3000)])
    for texts in cases:
        texts = [*texts, "card 4539 5787 6362 1486", "paid by 4539.5787.6362.1486 then"]
        models = pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
        assert all(models)
        for text, kind in [("ask for (407) 555-7710 there", "phone"), (texts[-1], "card"), ("or an.e7 (at) mail4.example.com here", "email")]:
            assert [pii.KINDS[k] for _, k, _ in pii.all_spans(text, models)[1]] == [kind], text
        for text in (texts[0], "in 1998-2003 there were 12345 items", "1,234,567.89 and 10.20.30", "we met at noon.Then", "years 2019 2020 2021"):
            assert pii.all_spans(text, models)[1] == [], text


def test_numbers_side_by_side_are_found_one_by_one(spark):
    lists = [
        ["(415) 555-0100", "(415) 555-0101", "(415) 555-0102"],
        ["555 123 4567", "555 123 4568"],
        ["4539 5787 6362 1486"] * 3,
        [f"({200 + i}) 555-{i:04}" for i in range(300)],
    ]
    models = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for numbers in lists:
        text = "ask " + " ".join(numbers) + " there"
        places = [(m.start(), m.end()) for n in dict.fromkeys(numbers) for m in re.finditer(re.escape(n), text)]
        assert set(places) <= {(a, b) for a, _, b in pii.candidates(text)}
        assert sorted(places) == [(a, b) for a, _, b in pii.all_spans(text, models)[1]]


def test_candidates_grow_with_the_text():
    for text in ("1 " * 100_000, "1." * 100_000, "1" + " " * 100_000 + "1", "(1" * 100_000, "1 " + "(" * 100_000, "1234 " * 40_000):
        assert sum(1 for _ in pii.proposed(text)) <= 20 * len(text)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a", 0), (2, "", "a", 0), (None, "x@y.z", "a", 0), (3, "1.2.3.4", "a", 0), (3, "1.2.3.4", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, kind int")
    got = sorted((str(r.doc_id), len(r.base), len(r.spans)) for r in pii.find_spans(docs).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("3", 1, 1), ("3", 1, 1), ("None", 1, 1)]
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (4000, 4)).astype(np.float32)
    y = (x[:, 0] > 4) ^ (x[:, 2] > 6)
    model = boosting.fit(x, y)
    p = model.probability(x)
    assert ((p >= 0.5) == y).mean() > 0.99
    noisy = rng.random(4000) < np.where(y, 0.8, 0.1)
    p = boosting.fit(x, noisy).probability(x)
    assert p[y].mean() == pytest.approx(0.8, abs=0.05) and p[~y].mean() == pytest.approx(0.1, abs=0.05)
    assert boosting.fit(x, np.zeros(4000, dtype=bool)) is None
