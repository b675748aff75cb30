"""Removal of repeated strings against a plain search, and its odd inputs."""

import hashlib
import random

import numpy as np
import pytest

from gneiss.llm import suffix_dedup
from gneiss.llm.suffix_dedup import LENGTH, dedup_strings, joined_runs

KIND = "doc_id long, text string"


def plain(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row; rows equal in both are one document."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0])):
        data = text.encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - LENGTH + 1):
            if data[s : s + LENGTH] in seen:
                gone[s : s + LENGTH] = True
            seen.add(data[s : s + LENGTH])
        left = bytes(c for c, g in zip(data, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i, text] = (i, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
    return sorted((out[i, t or ""] for i, t in rows), key=str)


def found(spark, rows, parts=3):
    got = dedup_strings(spark.createDataFrame(rows, KIND).repartition(parts)).collect()
    for r in got:
        assert hashlib.sha256(bytes(r["kept_bytes"])).hexdigest() == r["kept_sha256"] and len(r["spans"]) == 2 * r["n_spans"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str)


def sample(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéü漢 ") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passages = [" ".join(rng.choices(words, k=rng.randint(10, 80))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 60) :] if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(rng.randint(0, 6))]
        text = " ".join(parts)
        if rng.random() < 0.3 and rows:
            text = list(rng.choice(rows)[1] or "")
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = "Z"
            text = "".join(text)
        rows.append((i * 3, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_result_against_a_plain_search(spark, seed):
    rows = sample(seed)
    assert found(spark, rows) == plain(rows)


def test_many_classes_and_small_limits(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(i, "".join(rng.choice("ijkl") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 40) : rng.randint(200, 300)] + str(i) * 40) for i in range(150)]
    for name, value in (("MANY", 3), ("TOGETHER", 5000), ("PIECE", 600), ("SLOT", 4000), ("SHARD", 3000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert found(spark, rows) == plain(rows)


def test_odd_inputs(spark):
    unit = "0123456789" * 30
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 1000), (4, "x" * 1000), (5, unit), (5, unit[7:]), (6, "é" * 120), (None, unit), (None, "x" * 150), (7, "ab" * 400), (8, "y" * 50 + unit[:99])]
    got = found(spark, rows)
    assert [r for r in got if r[0] != 5] == [r for r in plain(rows) if r[0] != 5]
    fives = {r[1]: r[2] for r in got if r[0] == 5}
    assert fives[300] + fives[293] in (290 + 293, 283 + 300)
    assert dedup_strings(spark.createDataFrame([], KIND)).collect() == []
    one = spark.createDataFrame([("a", unit, 5), ("b", unit, 6)], "n_bytes string, text string, doc_id int")
    got = dedup_strings(one, keep=("n_bytes", "doc_id"), kept=False).toDF("a", "id", *"bcdefg").collect()
    assert sorted((r["a"], r["c"], r["g"]) for r in got) == [("a", 290, None), ("b", 300, None)]


def test_a_long_text_over_several_pieces(spark):
    rng = random.Random(8)
    block = "".join(rng.choice("abcdefghijklmnop") for _ in range(700_000))
    text = block + "#" + block[1000:] + "#" + block[:99]
    rows = [(1, text), (2, "q" + block[5000:9000])]
    got = dict((r[0], r[2:4]) for r in found(spark, rows))
    assert got == {1: (699_001, 1), 2: (4000, 1)}


def test_joined_runs():
    assert joined_runs(np.array([5, 0, 9, 20]), np.array([9, 3, 12, 30])).tolist() == [(0, 3), (5, 12), (20, 30)]
