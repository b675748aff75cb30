"""Exact expectations, ties and empty inputs of the operators; connectors on repositories made here."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from gneiss.config import Bands, Config
from gneiss.functions import paths, text as texts, udfs
from gneiss.functions.numeric import half_away, half_even, wilson_lower
from gneiss.operators import compare, coupling, folders, history, scoring, similarity
from gneiss.plans.components import connected_components
from gneiss.sources import cache, git, runs

DAY = 86_400


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rounding(spark):
    assert one(spark, half_even(F.lit(0.5), 0), half_even(F.lit(2.5), 0), half_away(F.lit(-0.0000005)), half_even(F.lit(0.125), 2)) == (0.0, 2.0, -0.000001, 0.12)
    assert one(spark, F.round(wilson_lower(F.lit(5.0), F.lit(10.0)), 4), wilson_lower(F.lit(0.0), F.lit(0.0))) == (0.2366, 0.0)


def test_paths(spark):
    rows = ["a.rs", "vendor/x.js", "src/generated/y.ts", "x/__snapshots__/a", "tests/fixtures/q.json", "db/migrations/test_1.sql", "pkg/a_test.go", ".github/workflows/ci.yml", "action.yml", "docs/a.txt", "README.md", "scripts/x.sh", "Cargo.toml", "lib/a.py", "man/x.1", "other/thing"]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    got = {r[0]: r[1] for r in df.select("path", paths.classification(F.col("path"))).collect()}
    want = ["other", "vendored", "generated", "snapshot", "fixture", "test", "test", "workflow", "workflow", "docs", "docs", "tool", "config", "source", "generated", "other"]
    want[5] = "migration_fixture"
    assert [got[r] for r in rows] == want
    assert one(spark, paths.ancestors(F.lit("a/b/c.rs")), paths.ancestors(F.lit("c.rs")), paths.root(F.lit("c.rs")), paths.parent(F.lit("c.rs"))) == ([".", "a", "a/b"], ["."], "c.rs", ".")
    assert paths.glob_regex("src/**/*.{rs,py}") == r"^src/(?:.*/)?.*\.(?:rs|py)$"
    with pytest.raises(ValueError):
        paths.in_scope(F.lit("x"), "../y")


def test_text_functions(spark):
    body = F.lit("# c\n\n/* a\n b */\nx = 1\n// n")
    assert tuple(one(spark, texts.text_lines(body, F.lit("Rust")))[0])[:4] == (6, 2, 3, 1)
    assert one(spark, texts.split_case(F.lit("HTTPServerErrorFoo"))) == ("HTTP Server Error Foo",)
    terms = {"queries": "query", "running": "run", "stopped": "stop", "classes": "classe", "status": "status", "settings": "set", "bed": "bed", "caches": "cache", "loggeds": "log"}
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert {r[0]: r[1] for r in df.select("t", texts.stem(F.col("t"))).collect()} == terms
    assert one(spark, texts.symbols(F.lit("pub fn abc() {}\nstruct Xy\nasync fn abc\nenum Longer"), F.lit("Rust"))) == (["abc", "Longer"],)
    assert one(spark, texts.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == (1.0,)
    assert one(spark, texts.mask_numbers(F.lit("a 12.5 b٣ 7"))) == ("a  0  b٣  0 ",)


def test_udfs():
    assert udfs.looks_binary_of(b"ab\x0c" * 9) and not udfs.looks_binary_of(b"ab\x7f" * 9)
    assert udfs.looks_binary_of(b"a\x00b") and not udfs.looks_binary_of(b"") and not udfs.looks_binary_of("é".encode("utf-16"))
    assert udfs.decode_of(b"\xef\xbb\xbfa\r\nb") == "a\nb" and udfs.decode_of(b"\xff\xfea\x00") == "a" and udfs.decode_of(b"\xff") is None
    assert udfs.truncate_utf8_of("aéb", 2) == "a"
    assert udfs.content_tokens_of("HTTPServer l’été snake_case x") == ["http", "server", "été", "snake", "case"]
    assert udfs.stable_id_of("a", ["b"]).startswith("a-") and len(udfs.stable_id_of("a", ["b"])) == 14


def touches(spark, rows):
    return spark.createDataFrame([(c, i, ts, a, b, "s", 1, "src/a.rs", st, 1, 0) for i, (c, ts, a, b, st) in enumerate(rows)], "commit_id string, seq long, ts long, author string, bot boolean, subject string, parents int, path string, status string, added long, deleted long")


def test_history_of_one_file(spark):
    now = 1_000_000_000
    rows = touches(spark, [("c", now - 10 * DAY, "bot", True, "M"), ("b", now - 100 * DAY, "x", False, "M"), ("a", now - 200 * DAY, "x", False, "A")])
    tracked = spark.createDataFrame([("src/a.rs", 4, 4)], "path string, lines int, tokens int")
    got = history.history_metrics(rows, tracked, now, Config()).first()
    assert (got["revisions"], got["added"], got["churn"], got["relative_churn"], got["late_spike"], got["author_entropy"], got["top_author_share"], got["days_since_human"], got["maintainers"]) == (2, 2, 2, 0.5, 0.5, 1.0, 0.5, 100, 1)
    assert got["recency"] == pytest.approx(1 / (1 + 10 / 30) + 1 / (1 + 100 / 30), abs=1e-6)
    assert history.first_seen(rows, now).first()["age_days"] == 200


def test_score_of_twenty_files(spark):
    rows = spark.createDataFrame([(f"src/{i:02}.rs", 100, i, 0, 0.0, "source") for i in range(1, 21)], "path string, tokens int, revisions int, age_days int, relative_churn double, classification string")
    got = {r["revisions"]: r for r in scoring.scored(rows, Config(bands=Bands(10, 20, 10**9))).collect()}
    assert [got[i]["revision_norm"] for i in (18, 19, 20)] == [0.947368, 1.0, 1.0] and max(r["score"] for r in got.values()) == 12.0


def test_folder_rollup_ties(spark):
    rows = spark.createDataFrame([("a/x.rs", 20000, 5.0), ("a/b/y.rs", 20000, 5.0), ("a/b/w.rs", 10, 1.0)], "path string, tokens long, score double").withColumns(
        {"bytes": F.lit(1), "revisions": F.lit(1), "churn_pressure": F.lit(0.0), "score_band": F.lit("low"), "classification": F.lit("source"), "reasons": F.array().cast("array<string>")}
    )
    got = {r["folder"]: r for r in folders.rollup(rows, Config()).collect()}
    assert got["."]["top_file"] == "a/b/y.rs" and got["a"]["n_direct"] == 1 and got["a"]["tokens"] == 40010 and set(got) == {".", "a", "a/b"}


def test_pagerank_of_two_and_empty(spark):
    kept = spark.createDataFrame([("a", "b", 3, 1), ("b", "a", 3, 1)], "src string, dst string, support long, position int")
    assert {tuple(r) for r in coupling.pagerank(kept).collect()} == {("a", 0.5), ("b", 0.5)}
    assert coupling.pagerank(kept.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 6), (9, 9), (3, 1), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 9: 9} | {100 + i: 100 for i in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lexical_pairs_without_terms(spark):
    rows = spark.createDataFrame([(f"r{i}/f", "shared", 2, 1) for i in range(5)], "path string, term string, count long, position int")
    got = similarity.lexical_pairs(rows, Config()).collect()
    assert len(got) == 10 and all(r["similarity"] == 1.0 and r["support"] == 0 for r in got)


def test_compare_of_equal_and_renamed(spark):
    schema = "path string, content string, tokens long, score double, context_band string, score_band string"
    base = spark.createDataFrame([("a", "1", 5, 1.0, "healthy", "low"), ("b", "2", 5, 1.0, "healthy", "low"), ("c", "3", 5, 1.0, "healthy", "low")], schema)
    head = spark.createDataFrame([("a", "1", 5, 1.0, "healthy", "low"), ("z", "2", 5, 1.0, "healthy", "low"), ("c", "4", 9, 70.0, "critical", "high")], schema)
    got = {r["path"]: r for r in compare.deltas(base, head).collect()}
    assert got["a"]["status"] == "unchanged" and got["z"]["renamed_from"] == "b" and got["c"]["context_delta"] == 3
    assert [tuple(r)[:3] for r in compare.regressions(compare.deltas(base, head), Config()).collect()] == [("c", "worse_band", "error")]
    assert compare.deltas(base.limit(0), head.limit(0)).count() == 0


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    where = str(tmp_path_factory.mktemp("repo"))

    def run(*args, day=0):
        date = f"{1_000_000_000 + day * DAY} +0000"
        env = os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": " a@x ", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x"}
        subprocess.run(["git", "-C", where, *args], check=True, capture_output=True, env=env)

    def write(name, data):
        os.makedirs(os.path.dirname(f"{where}/{name}") or where, exist_ok=True)
        with open(f"{where}/{name}", "wb") as f:
            f.write(data)

    run("init", "-q")
    write("src/a.rs", b"fn a() {}\r\nfn b() {}\n")
    write("img.bin", b"\x00\x01")
    run("add", "-A")
    run("commit", "-qm", "first", day=0)
    write("src/a.rs", b"fn a() {}\nfn c() {}\nfn d() {}\n")
    write("big.txt", b"x" * 5000)
    run("add", "-A")
    run("commit", "-qm", "second", day=1)
    run("mv", "src/a.rs", "src/z.rs")
    run("commit", "-qm", "move", day=2)
    return where


def test_git_source(spark, repo):
    assert git.tracked_paths(repo) == ["big.txt", "img.bin", "src/z.rs"]
    rows = git.read_touches(spark, repo, renames=True).orderBy("seq", "path").collect()
    assert [(r["seq"], r["subject"], r["path"], r["status"]) for r in rows] == [(0, "move", "src/z.rs", "R"), (1, "second", "big.txt", "A"), (1, "second", "src/a.rs", "M"), (2, "first", "img.bin", "A"), (2, "first", "src/a.rs", "A")]
    assert rows[0]["old_path"] == "src/a.rs" and rows[0]["author"] == "A <a@x>" and (rows[2]["added"], rows[2]["deleted"]) == (3, 2)
    files = {r["path"]: r for r in git.read_files(spark, repo, max_bytes=4096).collect()}
    assert files["big.txt"]["state"] == "too_large" and files["img.bin"]["state"] == "binary" and files["src/z.rs"]["text"].startswith("fn a()")
    assert git.clean_remote("https://me:pw@host/x.git?a=1#b") == "https://host/x.git" and git.clean_remote("/tmp/x").startswith("local-")


def test_runs_publish_prune_and_exports(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    for i in range(3):
        runs.publish({"files": spark.range(i + 1)}, root, f"r{i}")
    assert runs.load(spark, root, "files", "r1").count() == 2 and len(runs.list_runs(spark, root)) == 3
    assert len(runs.prune(spark, root, 1, 1 << 30)) == 2 and len(runs.list_runs(spark, root)) == 1
    queue = spark.createDataFrame([(1, "a,b%.rs", 90.0, "error", "critical", "healthy", ["old_file"], "T", "m\nn")], "position int, path string, score double, severity string, score_band string, context_band string, reasons array<string>, title string, message string")
    assert json.loads(runs.sarif(queue))["runs"][0]["results"][0]["level"] == "error"
    assert [runs.sarif_level(*b) for b in (("moderate", "healthy"), ("low", "warning"), ("low", "watch"), ("low", "critical"))] == ["warning", "warning", "note", "error"]
    assert runs.annotations(queue) == ["::error file=a%2Cb%25.rs,title=T::m%0An"]
    assert "| a,b%.rs | 90.0 |" in runs.markdown(queue, ["path", "score"])
    texts_ = spark.createDataFrame([("h1", "one two"), ("h2", "three")], "content string, text string")
    for _ in range(2):
        got = cache.cached_counts(texts_, f"file://{tmp_path}/cache", udfs.bpe_count(), 1, "byte_bpe_50k")
        assert {r["content"]: r["tokens"] for r in got.collect()}["h1"] == 2
    assert cache.Cache(spark, f"file://{tmp_path}/cache").entries().count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from gneiss.streaming import touches as streaming

    rows = spark.range(100).selectExpr("concat('p', id % 7) as path", "id as added", "id % 3 as deleted")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.maintain(stream, f"{tmp_path}/out")
    query.processAllAvailable()
    query.stop()
    want = rows.groupBy("path").agg(F.count("*"), F.sum("added"), F.sum("deleted"))
    assert sorted(map(tuple, streaming.totals(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_terms_counted_in_tasks_equal_terms_counted_by_spark(spark):
    import random

    from gneiss.config import Config
    from gneiss.functions import text as texts
    from gneiss.operators import similarity

    rng = random.Random(11)
    ends = ["", "s", "ss", "us", "is", "ies", "ing", "ed", "sed", "nning", "pped", "'s", "seses"]
    words = ["".join(rng.choices("abesIg_1é", k=rng.randint(0, 6))) + rng.choice(ends) for _ in range(900)] + ["the", "Lines", "runs", "\u212a1", "x"]
    texts_ = [" ".join(rng.choices(words, k=300)) for _ in range(40)]
    rows = spark.createDataFrame([(f"p{i % 35}", t) for i, t in enumerate(texts_)] + [("none", None), ("empty", "")], "path string, text string")
    got = {(r["path"], r["term"]): r["count"] for r in similarity.top_terms(rows, Config(top_terms=10_000)).collect()}
    token = rows.select("path", F.explode(texts.ascii_tokens(F.col("text"))).alias("token")).withColumn("term", texts.stem(F.col("token")))
    token = token.filter(~F.col("token").isin(*texts.UNHELPFUL) & ~F.col("term").isin(*texts.UNHELPFUL))
    assert got == {(r["path"], r["term"]): r["count"] for r in token.groupBy("path", "term").count().filter("count >= 2").collect()} and got


def test_a_long_prefix_sends_on_only_the_first_tests(spark):
    from gneiss.operators import overlays

    names = spark.range(6000).selectExpr("concat('src/reader_', id, '.rs') as path").union(spark.range(6000).selectExpr("concat('tests/x/test_', 'reader.', id, '.rs') as path"))
    found = overlays.test_mapping(names)
    weak = found.filter("strength = 2")
    assert weak.count() == 30_000 and weak.agg(F.countDistinct("test")).first()[0] == 5


def test_word_counts_are_made_without_the_words(spark):
    from gneiss.functions.udfs import content_token_count, content_tokens
    from gneiss.queries import QUERIES

    texts = [("fooBar HTTPServer l'eau x_yz",), ("",), (None,), ("ﬁne 12 a bc",)]
    rows = spark.createDataFrame(texts, "text string").select(F.size(content_tokens("text")).alias("a"), content_token_count("text").alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["b"] > 4
    plan = QUERIES["unicode_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "content_token_count" in plan and "content_tokens(" not in plan
