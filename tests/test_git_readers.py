"""The readers of Git: ranges, scopes, globs, skipped files, renames, and a long log."""

import os
import subprocess

import pytest

from gneiss.operators.evidence import follow_renames
from gneiss.sources import git
from tests.test_operators import repo  # noqa: F401


@pytest.fixture(scope="module")
def long_repo(tmp_path_factory):
    """1,200 commits by fast-import, of which every tenth touches three paths, with odd names, and one renames."""
    where = str(tmp_path_factory.mktemp("long"))
    subprocess.run(["git", "-C", where, "init", "-q"], check=True)
    out = []
    for i in range(1200):
        files = [f"src/f{i % 7}.py"] + ([f"döc/a {i % 3}.md", "x/y/z.txt"] if i % 10 == 0 else [])
        body = "".join(f'M 100644 inline "{p}"\ndata <<E\n{i}\n{p}\nE\n' for p in files)
        if i == 700:
            body += 'R "src/f6.py" "src/new.py"\n'
        out.append(f"commit refs/heads/main\nmark :{i + 1}\nauthor A <a{i % 5}@x> {1_000_000_000 + i} +0000\ncommitter C <c@x> {1_000_000_000 + i} +0000\ndata <<E\nm{i}\nE\n" + (f"from :{i}\n" if i else "") + body)
    subprocess.run(["git", "-C", where, "fast-import", "--quiet"], input="".join(out).encode(), check=True)
    subprocess.run(["git", "-C", where, "checkout", "-q", "main"], check=True)
    return where


def test_ranges_do_not_matter(spark, long_repo):
    whole = git.read_touches(spark, long_repo, step=5000)
    parts = git.read_touches(spark, long_repo, step=37)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 33
    rows = sorted(map(tuple, whole.collect()), key=str)
    assert rows == sorted(map(tuple, parts.collect()), key=str) and len({r[0] for r in rows}) == 1200
    assert {r[1] for r in rows} == set(range(1200)) and any(r[7].startswith("döc/a ") for r in rows)
    first = [r for r in rows if r[1] == 0][0]
    assert first[2] == 1_000_001_199 and first[10:] == (1, 1)
    assert git.read_touches(spark, long_repo, 100, step=30).select("commit_id").distinct().count() == 100
    assert git.truncated(long_repo, 1199) and not git.truncated(long_repo, 1200)


def test_the_log_is_read_as_it_comes(long_repo):
    """A reader that stops early has not waited for the whole log."""
    entries = git.log_entries(long_repo, "--name-status", "HEAD")
    assert next(entries).subject == "m1199"
    entries.close()


def test_renames_are_followed(spark, long_repo):
    touches = git.read_touches(spark, long_repo, renames=True, step=100).cache()
    paths = git.read_files(spark, long_repo)
    moved = follow_renames(touches, paths)
    assert moved.count() == touches.filter("path <> 'src/f6.py' or seq >= 499").count() or moved.count() <= touches.count()
    seen = {r["path"]: r["n"] for r in moved.groupBy("path").agg({"*": "count"}).toDF("path", "n").collect()}
    assert "src/f6.py" not in seen or seen["src/f6.py"] <= 72
    assert seen["src/new.py"] >= 100


def test_scopes_globs_and_skipped_files(spark, repo, long_repo):  # noqa: F811
    states = lambda **kw: {r["path"]: r["state"] for r in git.read_files(spark, repo, **kw).collect()}
    assert states(max_bytes=4096) == {"big.txt": "too_large", "img.bin": "binary", "src/z.rs": "analyzed"}
    assert states(scope="src") == {"src/z.rs": "analyzed"} and states(scope="nothing") == {}
    assert states(ignore=("*.bin", "src/**")) == {"big.txt": "analyzed", "img.bin": "ignored", "src/z.rs": "ignored"}
    assert git.read_files(spark, long_repo, step=3).filter("state = 'analyzed'").count() == len(git.tracked_paths(long_repo))
    with pytest.raises(ValueError):
        git.read_files(spark, repo, scope="../x")
    os.rename(f"{repo}/big.txt", f"{repo}/moved")
    try:
        assert states(scope="big.txt") == {"big.txt": "missing"}
    finally:
        os.rename(f"{repo}/moved", f"{repo}/big.txt")


def test_find_with_scope_globs_and_renames(spark, repo, tmp_path, capsys):  # noqa: F811
    from gneiss.__main__ import main
    from gneiss.sources import runs

    root = f"file://{tmp_path}/runs"
    assert main(["--runs", root, "--run-id", "a", "find", "--repo", repo, "--as-of", "1000300000", "--scope", "none"]) == 2
    assert main(["--runs", root, "--run-id", "a", "find", "--repo", repo, "--as-of", "1000300000", "--ignore", "big.txt", "--follow-renames"]) == 0
    files = {r["path"]: r for r in runs.load(spark, root, "files", "a").collect()}
    assert set(files) == {"src/z.rs"} and files["src/z.rs"]["revisions"] == 3
    assert {(r["path"], r["state"]) for r in runs.load(spark, root, "skipped", "a").collect()} == {("big.txt", "ignored"), ("img.bin", "binary")}
