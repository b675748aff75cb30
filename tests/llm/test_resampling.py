"""Importance resampling against a plain version, its tries, and its odd inputs."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gneiss.llm import resampling
from gneiss.llm.resampling import Trie, bucket_totals, features, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["The cat sat\ton the mat", "", None, "Ünï çödé-words ΑΒΓ 漢字漢字 x", "A1b2  A1B2!a1b2", "word " * 30, "y" * 500 + " " + "é" * 90, "\x00\x7fab{cd}ef", "end", "end of the cat " * 8]


def plain_features(text, longest=1):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + r]) for r in range(1, longest + 1) for i in range(len(words) - r + 1)]


def plain(rows, target, longest=1):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, out in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            for f in plain_features(text, longest)[1]:
                out[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000) / ((a + 1.0) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        words, own = plain_features(text, longest)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_whole_result_against_a_plain_version(spark, longest):
    rng = np.random.default_rng(2)
    vocabulary = ["alpha", "beta", "Gamma", "δέλτα", "eps1", "zeta", "eta", "théta", "x" * 70]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(120)]
    rows += [(500 + i, t) for i, t in enumerate(TEXTS)] + [(7, rows[7][1])] * 3 + [(None, "alpha " * 25)]
    target = ["beta beta zeta", None, "x" * 70, "", "eta théta"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, target, longest)


def test_small_tries_and_blocks_change_nothing(monkeypatch):
    texts = pa.array(TEXTS)

    def totals(nodes):
        trie = Trie(nodes=nodes)
        n = 0
        for _, data, bounds in resampling.blocks(texts):
            data, starts, ends, _, words = features(data, bounds, 2)
            trie.walk(data, starts, ends)
            n += words.sum()
        return n, trie.flush().tolist()

    want = [0] * 10000
    for t in TEXTS:
        for f in plain_features(t, 2)[1]:
            want[zlib.crc32(f.encode()) % 10000] += 1
    assert totals(1 << 12) == (sum(len(plain_features(t)[0]) for t in TEXTS), want)
    monkeypatch.setattr(resampling, "ROOM", 10)
    monkeypatch.setattr(resampling, "WALKED", 7)
    assert totals(80)[1] == want == totals(1 << 10)[1]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resample(empty, some).collect() == []
    assert sorted(r["n_features"] for r in resample(some, empty).collect()) == [0, 2]
    assert sum(bucket_totals(empty)) == 0
    clash = some.selectExpr("doc_id as weight", "text as score", "1 as doc_id", "2 as position")
    got = resample(clash, some, doc_id="weight", text="score").toDF("id", "f", "w", "s", "r").collect()
    assert {r["id"] for r in got} == {1, 2} and {r["r"] for r in got} == {None}


def test_a_very_long_text(spark):
    text = "lorem ipsum " * 700_000
    got = resample(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("lorem",)], "text string")).first()
    assert got["n_features"] == 1_400_000
