"""Approximate neighbours: recall and exact scores against brute force, and odd inputs."""

import math
import random

import numpy as np
import pytest

from gneiss.llm import neighbours
from gneiss.llm.queries import QUERIES


def brute(rows, every=50, k=5):
    rows = [(i, np.array(x, float)) for i, x in rows]
    out = {}
    for i, q in rows:
        if i % every == 0:
            scores = sorted(((-float(q @ x / (math.sqrt(q @ q) * math.sqrt(x @ x))), j) for j, x in rows if j != i))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows), answers(QUERIES["op2_nearest_neighbours"](spark, sf))
    assert recall(got, want) >= 0.9 and all(len(w) == len(got[i]) for i, w in want.items())
    exact = {i: dict(w) for i, w in want.items()}
    assert all(abs(s - exact[i][j]) < 1e-12 for i, g in got.items() for j, s in g if j in exact[i])


def test_ties_odd_vectors_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "LIST", 16)
    r = random.Random(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [r.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    odd = [(1000, None), (1050, [0.0] * 4), (1001, [1.0, None, 2.0, 3.0]), (1100, [math.nan, 1.0, 1.0, 1.0]), (1150, [math.inf, 1.0, 1.0, 1.0]), (1200, [1.0]), (1250, []), (None, [1.0, 1.0, 1.0, 1.0]), (1, rows[1][1])]
    df = spark.createDataFrame([(i, x, 1, 2.0) for i, x in rows + odd], "vec_id long, embedding array<double>, label int, score double").repartition(5)
    got, want = answers(neighbours.nearest_neighbours(df)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.97
    hot = [i for i in want if i % 3 == 0]
    assert all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in hot)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(50 * i, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
    got = answers(neighbours.nearest_neighbours(df))
    assert {i: len(g) for i, g in got.items()} == ({50 * i: n - 1 for i in range(n)} if n > 1 else {})


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(1)
    x = neighbours.unit(rng.normal(size=(6000, 16)))
    index = neighbours.fit(x, 60_000, 5)
    index.reach = 20
    q = neighbours.unit(rng.normal(size=(200, 16)))
    ids, _ = index.search(q, 20)
    exact = np.argsort(-(q @ index.centroids.T), axis=1)[:, :20]
    assert len(index.centroids) > 60 and np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids, exact, strict=True)]) > 0.9
