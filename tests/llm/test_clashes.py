"""Every operator over documents that have the names it uses itself as columns."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, linededup, mixing, quality, repair, secrets, sharding, simhash, substrings, tokencounts, whitening
from lectern.llm.queries import _tokenizer

# Names that the modules give to columns: every word in quotes that could be one.
NAMES = sorted(
    {w for f in Path(decontaminate.__file__).parent.glob("*.py") for w in re.findall(r"""["']([a-z_][a-z_0-9]{0,30})["']""", f.read_text())}
    - {"doc_id", "text", "source", "vec_id", "embedding", "conv_id", "turn", "role", "item_id", "quality", "toxic"}
)


def with_clashes(df):
    return df.select("*", *[F.lit(f"own {i}").alias(n) for i, n in enumerate(NAMES) if n not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(70)) + f"\nline {i % 4} of these words", f"s{i % 3}") for i in range(20)]
    rows += [(30, None, None), (None, "", "s1"), (3, rows[3][1], "s0"), (3, rows[3][1], "s0")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


OPERATORS = {
    "line dedup": lambda d: linededup.dedup_lines(d),
    "place": lambda d: sharding.place(d),
    "fingerprints": lambda d: simhash.near_duplicates(d),
    "tokens": lambda d: tokencounts.token_counts(d, _tokenizer()),
    "mix": lambda d: mixing.mix(d),
    "substrings": lambda d: substrings.remove_repeats(d),
    "decontamination": lambda d: decontaminate.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(5)),
    "secrets": lambda d: secrets.find_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_results_do_not_see_other_columns(docs, name):
    plain, clashing = (sorted(map(str, OPERATORS[name](d).collect())) for d in (docs, with_clashes(docs)))
    assert plain == clashing and (plain or name == "decontamination")


@pytest.mark.parametrize(
    "operator", [sharding.with_shard, simhash.keep_one, mixing.mixed_documents], ids=["with_shard", "keep_one", "mixed_documents"]
)
def test_columns_come_out_as_they_went_in(docs, operator):
    own = [n for n in NAMES if n not in ("shard", "source")]
    out = operator(with_clashes(docs))
    for row in out.select(*own).distinct().collect():
        assert list(row) == [f"own {NAMES.index(n)}" for n in own]
    shown = [c for c in docs.columns]
    assert sorted(map(str, out.select(*shown).collect())) == sorted(map(str, operator(docs).select(*shown).collect()))


def test_vectors_and_turns_with_clashes(spark, sf_dir):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0 / (i + 1)]) for i in range(30)], "vec_id bigint, embedding array<double>")
    shown = lambda d: sorted((r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 6)) for r in whitening.whiten(d).collect())
    assert shown(vectors) == shown(with_clashes(vectors))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(40)
    assert sorted(map(str, repair.repair(turns).summary.collect())) == sorted(map(str, repair.repair(with_clashes(turns)).summary.collect()))


def test_base_counts_of_quality_with_clashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(400)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, clashing = (sorted(map(str, quality.judge_quality(d, labels).collect())) for d in (docs, with_clashes(docs)))
    assert plain == clashing
