"""The library without its optional part, and what its queries' plans must not hold."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_works_without_the_optional_part(tmp_path):
    shutil.copytree(f"{HERE}/gneiss", tmp_path / "gneiss", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'action_queue' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_imports_the_optional_part():
    for folder, _, files in os.walk(f"{HERE}/gneiss"):
        if "llm" not in folder.split(os.sep):
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "gneiss.llm" not in f.read(), name


@pytest.mark.parametrize("name,columns", [("band_counts", "text"), ("history_metrics", "o_totalprice")])
def test_scans_read_only_what_they_need(spark, sf, name, columns):
    from gneiss.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    if columns == "o_totalprice":
        assert columns not in plan
