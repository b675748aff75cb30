"""The command line on a repository made here: find, then every reader of the run."""

import json

from gneiss.__main__ import main
from tests.test_operators import repo  # noqa: F401


def test_commands(spark, repo, tmp_path, capsys):  # noqa: F811
    runs = ["--runs", f"file://{tmp_path}/runs"]
    cache = f"file://{tmp_path}/cache"
    assert main([*runs, "--run-id", "one", "find", "--repo", repo, "--as-of", "1000300000", "--cache", cache]) == 0
    assert main([*runs, "--run-id", "two", "find", "--repo", repo, "--as-of", "1000400000"]) == 0
    assert main([*runs, "check"]) == 0
    assert main([*runs, "compare", "one", "two", "--fail-on-regression"]) == 0
    capsys.readouterr()
    assert main(["--set", "/history/max_commits=100", "prune-cache", cache, "--max-entries", "1"]) == 0
    assert json.loads(capsys.readouterr().out) == {"entries_before": 2, "bytes_before": 144, "entries": 1, "bytes": 72}
    assert main([*runs, "health", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["n_files"] == 2
    assert main([*runs, "list", "files", "--path", "src"]) == 0
    assert json.loads(capsys.readouterr().out)["path"] == "src/z.rs"
    assert main([*runs, "plan", "src/z.rs"]) == 0 and "src/z.rs" in capsys.readouterr().out
    assert main([*runs, "sarif"]) == 0 and json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert main([*runs, "prune", "--max-runs", "1"]) == 0 and capsys.readouterr().out.strip() == "one"
