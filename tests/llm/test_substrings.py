import hashlib

from lectern.llm import substrings
from lectern.llm.queries import QUERIES
from tests.llm import brute


def _brute(rows, window=50):
    first = {}
    for doc, text in rows:
        w = brute.words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            rank = (doc is None, doc)
            first[key] = min(first.get(key, rank), rank)
    result = []
    for doc, text in rows:
        w = brute.words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc is None, doc):
                gone.update(range(i, i + window))
        result.append((str(doc), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(result)


def _got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in df.collect())


def test_edges(spark):
    a, b = [f"a{i}" for i in range(70)], [f"b{i}" for i in range(60)]
    texts = {
        1: " ".join(a),
        2: "x " + "\n".join(a) + " y " + " ".join(b),
        3: " ".join(b) + " " + " ".join(b),
        4: " ".join(a[:49]),
        5: " ".join(a[:50]),
        6: None,
        7: "",
        8: " ".join(["same"] * 300),
        9: "s " * 10 + "same " * 120,
        10: " ".join(a[:60]) + " " + " ".join(a[5:70]),
        11: " ".join(f"é{i}" for i in range(50)) + " " + " ".join(a[10:65]),
    }
    rows = [*texts.items(), (None, " ".join(a)), (None, " ".join(f"n{i}" for i in range(55))), (5, " ".join(a[:50])), (5, " ".join(b[:55]))]
    docs = spark.createDataFrame([(d, t, d, "z") for d, t in rows], "doc_id bigint, text string, order_id bigint, seeds string")
    assert _got(substrings.remove_repeats(docs)) == _brute(rows)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in _brute(rows)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"](spark, sf_dir).collect())
    assert got == want
    assert any(g for _, _, g, _ in got)
