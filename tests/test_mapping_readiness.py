"""Test mapping by shared terms and globs against brute force; readiness of single runs."""

import random

from gneiss.functions.text import COMMON
from gneiss.operators import overlays, readiness


def test_shared_terms_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(40)] + ["zz", sorted(COMMON)[0]]
    terms = {f"src/f{i}.rs" if i % 3 else f"tests/t{i:03}.rs": set(rng.choices(words, k=rng.randint(0, 9))) for i in range(150)}
    rows = spark.createDataFrame([(p, t) for p, ts in terms.items() for t in ts] + [("src/gone.rs", "word1"), ("src/gone.rs", "word2")], "path string, term string")
    files = spark.createDataFrame([(p,) for p in terms], "path string")
    kept = {p: {t for t in ts if t not in COMMON and len(t) > 2} for p, ts in terms.items()}
    want = {(p, t) for p in terms for t in sorted(q for q in terms if q.startswith("tests/") and len(kept[p] & kept[q]) >= 2)[:5]}
    assert {tuple(r) for r in overlays.sharing_two(files, rows, 5).collect()} == want


def test_the_first_rule_that_holds_counts(spark):
    files = spark.createDataFrame([(p,) for p in ("src/parser.rs", "src/deep_reader_x.rs", "src/alone.rs", "tests/parser_test.rs", "tests/reader.rs", "tests/zeta.rs")], "path string")
    terms = spark.createDataFrame([(p, t) for p in ("src/parser.rs", "src/alone.rs", "tests/parser_test.rs", "tests/zeta.rs") for t in ("alpha", "beta")], "path string, term string")
    mappings = (("src/deep*", "tests/z*"), ("src/parser.rs", "none*"))
    found = overlays.test_mapping(files, terms=terms, mappings=mappings)
    got = sorted((r["path"], r["strength"], r["test"]) for r in found.collect() if r["path"].startswith("src/"))
    assert got == [("src/alone.rs", 3, "tests/parser_test.rs"), ("src/alone.rs", 3, "tests/zeta.rs"), ("src/deep_reader_x.rs", 0, "tests/zeta.rs"), ("src/deep_reader_x.rs", 2, "tests/reader.rs"), ("src/parser.rs", 1, "tests/parser_test.rs"), ("src/parser.rs", 3, "tests/zeta.rs")]
    strong = {r["path"]: r["strong"] for r in overlays.strongly_mapped(files, found, mappings).collect()}
    assert strong == {"src/parser.rs": True, "src/deep_reader_x.rs": True, "src/alone.rs": False, "tests/parser_test.rs": True, "tests/reader.rs": True, "tests/zeta.rs": True}


def frames(spark, status="complete", index=(("a", "c", "f", "analyzed", None),), public=(("a", "c", "f", "analyzed", None),), evidence=(), returned=1):
    record = "run string, path string, content string, fingerprint string, status string, reason string"
    return (
        spark.createDataFrame([("r", status, 0, "compact", True, True, True)], "run string, analysis_status string, omitted int, profile string, worktree_clean boolean, has_compare_index boolean, has_policy_index boolean"),
        spark.createDataFrame([("r", f"{k}_index/{c}", 1, returned, False) for k in ("compare", "policy") for c in ("files", "folders")], "run string, collection string, total long, returned long, truncated boolean"),
        spark.createDataFrame([("r", *x) for x in public], record),
        spark.createDataFrame([("r", *x) for x in index], record),
        spark.createDataFrame([("r", *x) for x in evidence], "run string, field string, status string"),
    )


def test_a_ready_run_and_what_spoils_it(spark):
    one = lambda *a, **kw: tuple(readiness.readiness(*frames(spark, *a, **{k: v for k, v in kw.items() if k != "allow"}), allow_incomplete=kw.get("allow", False)).first())
    assert one() == ("r", True, True, True, True, [])
    skipped = ("a", None, None, "skipped", "binary")
    assert one(index=[skipped], public=[skipped])[4]
    late = ("a", None, None, "skipped", "too_large")
    assert one(index=[late], public=[late]) == ("r", True, False, True, False, ["inventory_evidence_incomplete"])
    assert one(index=[late], public=[late], allow=True) == ("r", True, False, True, True, [])
    assert one(public=[("a", "other", "f", "analyzed", None)])[5] == ["comparison_index_inconsistent", "inventory_evidence_incomplete"]
    assert one(None, evidence=[("history", "incomplete_cap"), ("x", None)]) == ("r", False, True, False, False, ["analysis_incomplete", "evidence_incomplete"])
    assert one(returned=0)[5] == ["canonical_collection_incomplete"] * 2 + ["policy_index_incomplete"] * 2


def test_mismatches_by_field(spark):
    _, _, public, index, _ = frames(spark, public=[("a", None, "f", "analyzed", None), ("b", "c", None, None, None), (None, "c", None, None, None), ("d", "c", None, "s", "x")], index=[("a", None, "f", "skipped", "x"), ("d", "c", None, "s", "x"), ("d", "c", None, "t", "x")])
    got = {r["path"]: r["mismatches"] for r in readiness.reconciled(public, index).collect()}
    assert got == {"a": ["status", "reason"], "b": ["not_indexed"], None: ["no_path"], "d": []}


def test_totals_beside_bounded_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from gneiss.operators.compare import page_with_totals
    from gneiss.sources import runs

    root = f"file://{tmp_path}/runs"
    runs.publish({"all": spark.range(50), "some": spark.range(1000).repartition(7), "none": spark.range(0)}, root, "r1", {"some": ([F.desc("id")], 10), "none": ([F.asc("id")], 5)})
    told = {r["collection"]: (r["total"], r["returned"], r["limit"], r["truncated"]) for r in runs.load(spark, root, "collections").collect()}
    assert told == {"all": (50, 50, None, False), "some": (1000, 10, 10, True), "none": (0, 0, 5, False)}
    assert sorted(r["id"] for r in runs.load(spark, root, "some").collect()) == list(range(990, 1000))
    for offset, returned, more in ((0, 20, True), (90, 10, False), (200, 0, False)):
        rows, page = page_with_totals(spark.range(100).repartition(5), offset, 20, F.asc("id"))
        assert page == {"total": 100, "returned": returned, "limit": 20, "offset": offset, "truncated": True, "has_more": more}
        assert [r["position"] for r in rows.orderBy("position").collect()] == list(range(offset + 1, offset + returned + 1))


def test_runs_are_ordered_by_name(spark, tmp_path):
    import os

    from gneiss.sources import runs

    root = f"file://{tmp_path}/runs"
    for name in ("2024", "2023", "2025"):
        runs.publish({"t": spark.range(1)}, root, name)
    os.utime(tmp_path / "runs" / "run=2023", (4e9, 4e9))
    assert [r[0] for r in runs.list_runs(spark, root)] == ["2025", "2024", "2023"]
    assert set(runs.prune(spark, root, 1, 1 << 30)) == {"2024", "2023"}
    assert [r[0] for r in runs.list_runs(spark, root)] == ["2025"]


def test_names_are_found_in_paths_without_false_candidates(spark):
    rng = random.Random(5)
    paths = [f"tests/{rng.choice('ab')}/test_part_{rng.randint(0, 3)}_{i}.x_{i % 5}.rs" for i in range(120)] + ["tests/ba/b.rs", "tests/Ünï/ß_1.rs"]
    names = sorted({f"part_{k}" for k in range(5)} | {f"part_{i % 4}_{i}" for i in range(130)} | {"a", "b", "tests", "x_3", "ünï", "ß", "nothing"})
    tests = spark.createDataFrame([(p, p.lower()) for p in paths], "test string, low string")
    needles = spark.createDataFrame([(n,) for n in names], "needle string")
    want = {(n, p) for n in names for p in sorted(q for q in paths if n in q.lower())[:5]}
    assert sorted(map(tuple, overlays.containing(needles, tests, 5).collect())) == sorted(want)


def test_equal_parts_send_on_only_the_first_tests(spark):
    tests = spark.range(20_000).selectExpr("concat('tests/reader/t', id, '.rs') as test").selectExpr("test", "test as low")
    needles = spark.createDataFrame([("reader",), ("test",), ("t7",)], "needle string")
    found = overlays.containing(needles, tests, 5)
    assert {r["needle"]: r["count"] for r in found.groupBy("needle").count().collect()} == {"reader": 5, "test": 5, "t7": 5}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "Contains" not in plan
