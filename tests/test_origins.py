"""Verification commands and the origins of generated files, branch by branch."""

from gneiss.operators import provenance, verification
from gneiss.operators.provenance import Mapping


def commands(spark, tracked, wanted, *args, **kw):
    frame = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    rows = verification.verification_commands(frame(wanted), frame(tracked), *args, **kw).orderBy("path", "position").collect()
    out = {}
    for r in rows:
        out.setdefault(r["path"], []).append(r["command"])
    return out


def test_nested_manifests_in_order(spark):
    tracked = ["Cargo.toml", "packages/web/package.json", "packages/web/pnpm-lock.yaml", "services/api/pom.xml", "net/a/x.sln", "net/.csproj", "py/pyproject.toml", "py/package.json", "js/package.json", "js/bun.lockb", "js/yarn.lock"]
    got = commands(spark, tracked, ["packages/web/src/app.ts", "services/api/src/Main.java", "net/a/b.cs", "net/c.cs", "py/x.py", "js/y.js", "top.rs"], ("./scripts/verify.sh",))
    cargo = list(verification.MANIFESTS[0][1])
    first = ["./scripts/verify.sh", *cargo]
    assert got == {
        "packages/web/src/app.ts": [*first, "cd packages/web && pnpm test"],
        "services/api/src/Main.java": [*first, "cd services/api && mvn test"],
        "net/a/b.cs": [*first, "cd net/a && dotnet test"],
        "net/c.cs": first,
        "py/x.py": [*first, "cd py && pytest"],
        "js/y.js": [*first, "cd js && bun test"],
        "top.rs": first,
    }


def test_configured_families_replace_what_is_found(spark):
    given = ("cargo fmt --all -- --check", "cargo clippy --workspace -- -D warnings", "cargo test --workspace --locked")
    assert commands(spark, ["Cargo.toml"], ["src/contract.rs"], given) == {"src/contract.rs": list(given)}


def test_globs_generated_files_and_near_tests(spark):
    generated = spark.createDataFrame([("a/x.yml", "make check"), ("b.yml", " "), ("c.yml", None)], "path string, verification_command string")
    nearby = spark.createDataFrame([("a/x.yml", "tests/two.rs"), ("a/x.yml", "tests/one.rs"), ("a/x.yml", "tests/deep/no.rs")], "path string, test string")
    got = commands(spark, [], ["a/x.yml", "b.yml", "c.yml"], (), (("a/*", "lint"), ("*.yml", "lint")), generated, nearby)
    assert got == {"a/x.yml": ["lint", "make check", "cargo test --test one", "cargo test --test two"], "b.yml": ["lint"], "c.yml": ["lint"]}
    assert commands(spark, ["x"], ["x"]) == {}


def origins(spark, files, mappings=()):
    a, b = provenance.provenance(spark.createDataFrame(files, "path string, text string"), mappings)
    found = {r["path"]: (r["source_globs"], r["generator"], r["verification_command"], r["n_sources"], r["generated_from"]) for r in a.collect()}
    sources = {}
    for r in b.collect():
        sources.setdefault(r["path"], set()).add(r["source"])
    return found, sources


def test_markers_globs_and_mappings(spark):
    files = [
        ("a.rs", "// @Generated from spec/*.proto by make gen\nx"),
        ("b.rs", "x\n/* @generated from spec/one.proto by   generate-release-workflow --all "),
        ("c.rs", "1\n2\n3\n// @generated from spec/one.proto"),
        ("d.rs", "# @generated from gone.txt"),
        ("e.rs", "# @generated from [broken"),
        ("f.rs", None),
        ("spec/one.proto", ""),
        ("spec/in/two.proto", "x @generated from a.rs by b by c"),
        ("m/g.rs", "# @generated from spec/one.proto"),
    ]
    found, sources = origins(spark, files, (Mapping("m/*", ("spec/[o]*", "none*"), "build"), Mapping("*.rs")))
    assert found == {
        "a.rs": (["spec/*.proto"], "make gen", None, 2, None),
        "b.rs": ([], "generate-release-workflow --all", "generate-release-workflow --all --check", 1, None),
        "d.rs": ([], None, None, 0, ["gone.txt"]),
        "e.rs": (["[broken"], None, None, 0, ["[broken"]),
        "spec/in/two.proto": ([], "b by c", None, 1, None),
        "m/g.rs": (["spec/[o]*", "none*"], "build", None, 1, None),
    }
    assert sources == {"a.rs": {"spec/one.proto", "spec/in/two.proto"}, "b.rs": {"spec/one.proto"}, "spec/in/two.proto": {"a.rs"}, "m/g.rs": {"spec/one.proto"}}


def test_globs_are_looked_up_and_not_compared_with_all_paths(spark):
    paths = spark.range(20_000).selectExpr("concat('src/d', id % 50, '/f', id, '.rs') as path")
    globs = spark.createDataFrame([("src/d3/*",), ("*7.rs",), ("**/d4/*1?3.rs",), ("nowhere/*",)], "glob string")
    rows = provenance.resolved(globs, paths)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["glob"]: r["count"] for r in rows.groupBy("glob").count().collect()}["src/d3/*"] == 400
    assert rows.filter("glob = 'src/d3/*'").count() == 400 and rows.filter("glob = '*7.rs'").count() == 2000


def shuffled(spark):
    """Records that all stages so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_paths_and_sources_are_not_shuffled(spark):
    files = [(f"gen/f{i}.rs", "# @generated from spec/*.proto") for i in range(700)] + [(f"spec/s{i}.proto", "") for i in range(700)] + [("two.rs", "")]
    mappings = (Mapping("two.rs", ("spec/s1*", "spec/s12*")),)
    before = shuffled(spark)
    found, sources = provenance.provenance(spark.createDataFrame(files, "path string, text string"), mappings)
    assert {r["n_sources"] for r in found.filter("path like 'gen/%'").collect()} == {700}
    assert sources.count() == sources.distinct().count() == 490_000 + 111
    parts = provenance.in_blocks(spark.range(50).selectExpr("id % 2 as k", "id as l"), spark.range(30).selectExpr("id % 3 as k", "id as r"), "k", 4)
    assert sorted(map(tuple, parts.collect())) == sorted((a, b) for a in range(50) for b in range(30) if a % 2 == b % 3)
    sources.write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 490_000 + 100_000


def test_marked_files_are_generated(spark):
    from gneiss.config import Config
    from gneiss.operators.inventory import inventory

    rows = spark.createDataFrame([("src/release.yml", "# @generated from reviewed stage fragments\nname: Release\n", 1, 1), ("src/a.rs", "fn a() {}", 1, 1), ("src/b.rs", None, 1, 1)], "path string, text string, bytes long, tokens long")
    assert {r["path"]: r["classification"] for r in inventory(rows, Config(), marked=True).collect()} == {"src/release.yml": "generated", "src/a.rs": "source", "src/b.rs": "source"}
