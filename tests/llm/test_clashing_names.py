"""Pipeline stages leave a caller's columns alone, whatever they are called."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
NAMES = ("__id", "__key", "__n", "__h", "__runs", "__kept", "__cleaned", "__position", "c0")


@pytest.mark.parametrize("step", [s for s in corpus_pipeline.STAGES[:4]], ids=lambda s: s[0])
def test_columns_come_through(spark, step):
    rng = random.Random(1)
    text = lambda: ". ".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(9)) for _ in range(12)) + "."
    rows = [(i, text(), "en", "s", 10, *[f"{n}{i}" for n in NAMES]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in NAMES))
    out = step[1](spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in NAMES)
