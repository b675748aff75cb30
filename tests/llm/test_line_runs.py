"""Line dedup and the whole pipeline against plain versions."""

import random
import re

import pytest

from gneiss.llm.queries import PIECE_BPE, QUERIES, vocabulary
from tests.llm.test_similar_texts import similar_heads
from tests.llm.test_text_operators import empty, odd, texts  # noqa: F401


def plain_dedup(rows, least=50):
    """{(doc_id, text): text without later copies of runs}, from the longest common run of every two places with equal lines."""
    docs = sorted({(d, t) for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    spans, lines = [], []
    for d, t in docs:
        split = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in t.split("\n")]
        own = [(i, tuple(w)) for i, w in enumerate(split) if w]
        spans.append((d, t, len(lines), own))
        lines += [w for _, w in own] + [None]
    places, longest, after = {}, [0] * len(lines), {}
    for p, w in enumerate(lines):
        places.setdefault(w, []).append(p)
    for p in range(len(lines) - 1, -1, -1):
        here = {q: 1 + after.get(q + 1, 0) for q in places[lines[p]] if q < p} if lines[p] else {}
        longest[p], after = max(here.values(), default=0), here
    out = {}
    for d, t, start, own in spans:
        gone = set()
        for k in range(len(own)):
            n = longest[start + k]
            if n and sum(len(w) for _, w in own[k : k + n]) >= least:
                gone |= set(range(own[k][0], own[k + n - 1][0] + 1))
        out[d, t] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    r, path = random.Random(9), str(tmp_path_factory.mktemp("copied"))
    line = lambda: " ".join(r.choice("abcdefgh") * 3 for _ in range(r.randint(1, 25)))
    pool = [line() for _ in range(12)]
    passage = [line() for _ in range(7)]
    rows = []
    for i in range(120):
        own = [r.choice(pool) if r.random() < 0.4 else line() for _ in range(r.randint(0, 9))]
        if i % 3 == 0:
            k = r.randint(0, len(own))
            own[k:k] = passage if i % 2 else passage[1:5] + [""] + passage[5:]
        if i % 10 == 9:
            own = own * 2
        rows.append((i, "\n".join(own)))
    rows += [(200, rows[30][1]), (201, rows[30][1]), (200, rows[30][1]), (None, rows[30][1]), (5, rows[31][1])]
    rows = [r for r in rows if r[0] != 5 or r is rows[-1]]
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t), 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, runs long").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("where", ["sf", "odd", "empty", "copied"])
def test_line_dedup(spark, where, request):
    path = request.getfixturevalue(where)
    got = [(r["doc_id"], r["text"]) for r in QUERIES["op6_line_dedup"](spark, path).collect()]
    rows = texts(spark, path)
    plain = plain_dedup(rows)
    assert sorted(got, key=str) == sorted(((d, plain[d, t]) for d, t in rows), key=str)
    if where == "copied":
        assert sum(a != b for (_, a), (_, b) in zip(sorted(got, key=str), sorted(rows, key=str), strict=True)) > 20


@pytest.mark.parametrize("where", ["sf", "odd", "empty", "copied"])
def test_pipeline_stages(spark, where, request, tmp_path):
    import corpus_pipeline
    from gneiss.llm.quality import measure

    path = request.getfixturevalue(where)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, tables[-1], path).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    pairs = [[(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()] for t in tables[:5]]
    assert all(t.columns == columns for t in tables[:5])
    want = [(d, measure(t or "")[7]) for d, t in pairs[0] if measure(t or "")[6]]
    assert sorted(pairs[1], key=str) == sorted(want, key=str)
    plain = plain_dedup(pairs[1])
    want = [(d, plain[d, t]) for d, t in pairs[1] if plain[d, t].split()]
    assert sorted(pairs[2], key=str) == sorted(want, key=str)
    heads = {}
    for (d, _), head in zip(pairs[2], similar_heads([t for _, t in pairs[2]]), strict=True):
        heads.setdefault(head, []).append(d)
    least = [min(own, key=lambda d: (d is None, d or 0)) for own in heads.values()]
    assert sorted((d for d, _ in pairs[3]), key=str) == sorted(least, key=str) and set(pairs[3]) <= set(pairs[2])
    assert set(pairs[4]) <= set(pairs[3])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(size(t) for _, t in pairs[3])
    if where == "sf":
        assert abs(sum(size(t) for _, t in pairs[4]) - total) < 0.1 * total
    last = tables[5].collect()
    assert sorted((r["doc_id"] for r in last), key=str) == sorted((d for d, _ in pairs[4]), key=str)
    if where == "sf":
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
        texts_ = dict(pairs[4])
        assert all(list(r["ids"]) == spm.encode(texts_[r["doc_id"]], add_eos=True) for r in last)


def test_run_agrees_with_stages(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()
    assert len(rows) > 50 and sorted(rows) == sorted(corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect())
