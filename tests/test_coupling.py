"""Ranks and neighbours of coupled paths: results against plain loops, and how often their plans shuffle."""

import random
import re

import pytest

from gneiss.operators import coupling
from gneiss.queries import history

CFG = history.CFG


@pytest.fixture
def shuffled(spark):
    """Joins of tables that are small here are planned as those of large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_equal_a_plain_loop_and_rounds_shuffle_numbers(spark, shuffled, monkeypatch):
    r = random.Random(18)
    kept = [(f"p{a}", f"p{b}", r.randint(1, 9)) for a in range(30) for b in r.sample(range(34), 5) if a != b]
    plans, stage = [], coupling.stage
    monkeypatch.setattr(coupling, "stage", lambda df, name: plans.append((name, df)) or stage(df, name))
    got = dict(map(tuple, coupling.pagerank(spark.createDataFrame(kept, "src string, dst string, support long")).collect()))
    nodes = sorted({a for a, _, _ in kept})
    total = {n: sum(s for a, _, s in kept if a == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        rank = {n: 0.15 / len(nodes) + 0.85 * sum(rank[a] * s / total[a] for a, b, s in kept if b == n) for n in nodes}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-6 for n in nodes)
    rounds = [df for name, df in plans if name == "ranks"]
    assert len(rounds) == 4 and all(df.dtypes == [("node", "bigint"), ("got", "double")] for df in rounds)
    assert max(plan(df).count("Exchange hashpartitioning") for df in rounds) <= 11


def test_no_sources_no_ranks(spark):
    assert coupling.pagerank(spark.createDataFrame([], "src string, dst string, support long")).collect() == []


def test_neighbours_pair_spread_touches_without_more_shuffles(spark, sf, shuffled, monkeypatch):
    monkeypatch.setattr(history.fx, "TASK_ROWS", 100)
    rows = history.neighbors_top20(spark, sf)
    text = plan(rows)
    assert "Union" not in text and not re.search(r"hashpartitioning\(commit_id#\d+L?, path", text)
    edges = [(r["a"], r["b"], r["support"]) for r in history.cochange_edges(spark, sf).collect()]
    near = {}
    for a, b, s in edges:
        near.setdefault(a, []).append((-s, b))
        near.setdefault(b, []).append((-s, a))
    want = {(p, d, -s, i + 1) for p, ds in near.items() for i, (s, d) in enumerate(sorted(ds)[: CFG.max_pairs])}
    assert {(r["src"], r["dst"], r["support"], r["position"]) for r in rows.collect()} == want


def test_touches_do_not_broadcast_orders(spark, sf):
    assert "SortMergeJoin" in plan(history.freshness(spark, sf))
