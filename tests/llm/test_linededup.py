import random

from lectern.llm import linededup
from tests.llm import brute


def _edited(a, b, least):
    if len(a) == len(b) >= least:
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and len(long) >= least and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _near(a, b):
    if a == b or _edited(a, b, 4):
        return True
    return max(len(a), len(b)) < 4 and _edited(" ".join(a), " ".join(b), 8)


def _brute(rows):
    lines = []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        lines += [((doc, text), i, brute.words(line.lower())) for i, line in enumerate((text or "").split("\n"))]
    gone = {}
    for k, (key, i, words) in enumerate(lines):
        if words and any(w and _near(words, w) for _, _, w in lines[:k]):
            gone.setdefault(key, set()).add(i)
    result = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        own = gone.get((doc, text), set())
        result.append((str(doc), len(parts), len(own), "\n".join(p for i, p in enumerate(parts) if i not in own)))
    return sorted(result)


def _got(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in df.collect())


def test_random_lines_against_all_pairs(spark):
    rnd = random.Random(3)
    base = [[f"w{rnd.randint(0, 5)}" for _ in range(rnd.randint(1, 9))] for _ in range(40)]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(rnd.randint(1, 5)):
            line = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(line) + 1)
                line[at : at + rnd.randint(0, 1)] = [f"w{rnd.randint(0, 5)}"] * rnd.randint(0, 1)
            text.append("  ".join(line).upper() if rnd.random() < 0.2 else " ".join(line))
        rows.append((doc, "\n".join(text)))
    rows += [(60, None), (61, ""), (62, "\n \n\t"), (63, rows[0][1]), (63, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, line_no int, digest string")
    assert _got(linededup.dedup_lines(docs)) == _brute(rows)


def test_short_lines_and_scripts_without_blanks(spark):
    rnd = random.Random(9)
    base = ["see page 12", "see page 1", "abcdefg", "abcdefgh", "ab cd ef", "這是一個很長的句子沒有空格", "これは長い文です。", "x", "a b", "one two three", "one two three four", "ONE two"]
    lines = []
    for _ in range(220):
        line = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(line) + 1)
            line[at : at + rnd.randint(0, 1)] = [rnd.choice("abc 文é😀")] * rnd.randint(0, 1)
        lines.append("".join(line))
    rows = [(i, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id bigint, text string, kind int, units string")
    assert _got(linededup.dedup_lines(docs)) == _brute(rows)
    gone = {d: n for d, _, n, _ in _got(linededup.dedup_lines(spark.createDataFrame([(1, "這是一個很長的句子"), (2, "這是一個很長句子"), (3, "完全不同的另一個句子")], "doc_id bigint, text string")))}
    assert gone == {"1": 0, "2": 1, "3": 0}


def test_lines_with_the_same_beginnings_and_ends(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:20], *[f"x{i}-{k}" for k in range(20)], *words[40:]])) for i in range(12)]
    rows += [(20, rows[3][1].replace("x3-7", "changed")), (21, rows[5][1].replace(" x5-0", ""))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _got(linededup.dedup_lines(docs)) == _brute(rows)


def test_long_lines_and_missing_ids(spark):
    long = [f"v{i % 977}" for i in range(20_000)]
    other = [*long[:9_000], "changed", *long[9_001:]]
    rows = [(1, " ".join(long)), (2, "head\n" + " ".join(other)), (3, " ".join(other[:-1])), (None, "head")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _got(linededup.dedup_lines(docs)) == [("1", 1, 0, rows[0][1]), ("2", 2, 2, ""), ("3", 1, 1, ""), ("None", 1, 0, "head")]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_variants_that_come_once_are_left_out_before_the_joins(spark, monkeypatch):
    rows, plain = {}, linededup.landed

    def counted(df, name):
        rows[name] = (out := plain(df, name)).count()
        return out

    monkeypatch.setattr(linededup, "landed", counted)
    # The lines share a half, and only the last two are within one edit of another.
    texts = [(i, " ".join([*"abcde", *[f"x{i}-{k}" for k in range(5)]])) for i in range(20)]
    texts += [(20, texts[3][1].replace("x3-2", "y")), (21, texts[5][1].replace(" x5-0", ""))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert _got(linededup.dedup_lines(docs)) == _brute(texts)
    assert 0 < rows["together"] < rows["variants"] / 10
