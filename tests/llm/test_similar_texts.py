"""The near-dedup stage against the similarities of all pairs."""

import random

import numpy as np

from gneiss.llm.similar_texts import open_pairs, parities, print_pairs, set_print


def similar_heads(texts, words=5, least=0.8):
    """For each text the number of the first text that similarities of all pairs connect it with."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))))
    head = list(range(len(sets)))

    def root(d):
        while head[d] != d:
            d = head[d]
        return d

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) / len(x | y) >= least:
                lo, hi = sorted((root(a), root(b)))
                head[hi] = lo
    return [root(d) for d in range(len(sets))]


def plain_groups(rows):
    """{doc_id: smallest doc_id its similarities connect it with}."""
    rows = sorted(rows)
    return {d: rows[h][0] for (d, _), h in zip(rows, similar_heads([t for _, t in rows]), strict=True)}


def test_one_of_each_of_all_similar_pairs(spark):
    import corpus_pipeline

    r = random.Random(5)
    rows = []
    for i in range(25):
        base = ["common"] * 3 + [r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(r.choice([3, 30, 200, 400]))]
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            own = [f"new{r.random()}" if r.random() < share else w for w in base]
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), ""), (len(rows) + 1, " "), (len(rows) + 2, "common common common a"), (len(rows) + 3, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    heads = plain_groups(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(set(heads.values()))
    assert 30 < len(got) < 150 and {tuple(r) for r in got} <= set(rows)


def test_open_pairs_lose_no_similar_pair(spark):
    """Of random sets that share a shingle, the join may leave out none that is similar enough."""
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(300)]
    rows, sets = [], {}
    for sid in range(60):
        own = np.unique(np.array([base[0], *rng.sample(base[1:], rng.randint(150, 299)), *[rng.getrandbits(63) for _ in range(rng.randint(0, 80))]], np.int64))
        sets[sid] = set(own.tolist())
        rows.append((sid, len(own), parities(own).tolist()))
    table = spark.createDataFrame(rows, "sid long, n int, odd array<long>")
    apart = table.selectExpr(f"{base[0]}L as s", "sid", "sid as c")
    got = {(r["a"], r["b"]) for r in open_pairs(apart, table, 0.8).collect()}
    every = {(a, b) for a in sets for b in sets if a < b}
    want = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and want <= got < every


def test_simhash_links_sets_of_close_fingerprints(spark):
    """The stage's first step: SimHash connects what all pairs of at most four differing bits connect."""
    rng = random.Random(4)
    rows = []
    for k in range(30):
        base = [rng.getrandbits(64) - (1 << 63) for _ in range(400)]
        for j in range(4):
            own = np.unique(np.array([*base[: 400 - j], *[rng.getrandbits(64) - (1 << 63) for _ in range(j)]], np.int64))
            rows.append((set_print(own), 10 * k + j))
    rows.append((rows[0][0], 999))
    prints = {sid: fp for fp, sid in rows}

    def parted(edges):
        head = {s: s for s in prints}
        for _ in prints:
            for a, b in edges:
                head[a] = head[b] = min(head[a], head[b])
        return head

    got = [(r["a"], r["b"]) for r in print_pairs(spark.createDataFrame(rows, "fp long, sid long")).collect()]
    close = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & ((1 << 64) - 1)).bit_count() <= 4]
    assert len(close) > 60 and parted(got) == parted(close)


def test_near_dedup_goes_through_simhash(spark, monkeypatch):
    """What SimHash finds reaches the comparison on whole sets, and what it misses is found all the same."""
    import corpus_pipeline
    from gneiss.llm import similar_texts

    asked = []
    real = similar_texts.links
    monkeypatch.setattr(similar_texts, "links", lambda reps, plan, most: asked.append(reps.count()) or real(reps, plan, most))
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:-1], "x"])), (2, " ".join([*words[:50], "y", "y", *words[52:120], "y", *words[121:]])), (3, "of its own kind")]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()) == [0, 3]
    assert len(asked) == 1 and asked[0] > 1
