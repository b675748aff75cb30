"""Queries far from everything still get their full number of neighbours."""

import numpy as np

from gneiss.llm.neighbours import nearest_neighbours


def test_outliers_have_all_their_neighbours(spark):
    rng = np.random.default_rng(1)
    blob = rng.normal(size=(6000, 8)) * 0.05 + np.eye(8)[0]
    far = rng.normal(size=(3, 8)) * 0.05 - np.eye(8)[0]
    ids = [*range(1, 6001), 0, 50_000, 100_000]
    rows = [(i, [float(v) for v in x]) for i, x in zip(ids, [*blob, *far], strict=True)] + [(7, None), (9_999_950, []), (9_999_900, [0.0] * 8)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(sizes) == {i for i in ids if i % 50 == 0} and all(len(v) == 5 for v in sizes.values())
    assert {50_000, 100_000} <= sizes[0]
