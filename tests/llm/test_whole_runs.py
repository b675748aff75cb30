"""Line dedup against a search over windows of all lengths."""

import random

import pytest

from gneiss.llm.queries import QUERIES


def every_length(rows, least=50):
    """{doc_id: text without later copies}, from windows of every length compared one by one."""
    docs, first, at = [], {}, 0
    for d, t in sorted(rows):
        own = [(i, tuple(x.split())) for i, x in enumerate(t.split("\n")) if x.split()]
        docs.append((d, t, at, own))
        for n in range(1, len(own) + 1):
            for p in range(len(own) - n + 1):
                first.setdefault(tuple(w for _, w in own[p : p + n]), at + p)
        at += len(own) + 1
    out = {}
    for d, t, start, own in docs:
        gone = set()
        for p in range(len(own)):
            for q in range(p + 1, len(own) + 1):
                run = tuple(w for _, w in own[p:q])
                if sum(map(len, run)) >= least and first[run] < start + p:
                    gone |= set(range(own[p][0], own[q - 1][0] + 1))
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def dedup(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return {r["doc_id"]: r["text"] for r in QUERIES["op6_line_dedup"](spark, path).collect()}


def test_run_pieced_together_from_several_documents(spark, tmp_path):
    line = lambda name: " ".join(f"{name}{i}" for i in range(20))
    docs = ["X l2 l3", "l1 l2 l3", "Y l1 l2 l3", "R R R R R R R"]
    rows = [(i, "\n".join(map(line, d.split()))) for i, d in enumerate(docs)]
    got = dedup(spark, str(tmp_path), rows)
    assert got == every_length(rows)
    assert got[2] == line("Y") and got[3] == line("R")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_documents(spark, tmp_path, seed):
    r = random.Random(seed)
    size = lambda: r.choice([1, 2, 5, 9, 17, 30, 49, 50, 60])
    pool = [" ".join(f"{i}w{j}" for j in range(size())) for i in range(9)]
    rows = []
    for i in range(150):
        own = [r.choice(pool) for _ in range(r.randint(0, 12))] if i % 3 else (pool + pool)[r.randint(0, 8) :][: r.randint(1, 9)]
        rows.append((i, "\n".join(x for y in own for x in ([y] if r.random() < 0.8 else ["", y]))))
    got = dedup(spark, str(tmp_path), rows)
    assert got == every_length(rows)
    assert sum(got[d] != t for d, t in rows) > 30
