"""Layered settings against folding the layers one by one; typed access; budgets."""

import json
import random

import pytest

from gneiss.config import Config, configured
from gneiss.operators import budget, settings


def folded(layers):
    out = {}
    for text in layers:
        try:
            value = json.loads(text)
        except ValueError:
            continue
        if isinstance(value, dict):
            merge(out, value)
    return out


def merge(base, more):
    for k, v in more.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            merge(base[k], v)
        else:
            base[k] = json.loads(json.dumps(v))


def flat(value, at=""):
    rows = {}
    for k, v in value.items():
        p = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
        rows |= flat(v, p) if isinstance(v, dict) and v else {p: v}
    return rows


def made(rng, depth=0):
    return {rng.choice(["a", "b", "c/d", "e~"]): made(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else rng.choice([1, "x", [1, {"y": 2}], None, True, {}]) for _ in range(rng.randint(0, 3))}


def test_merge_equals_folding(spark):
    rng = random.Random(11)
    owners = {o: [json.dumps(made(rng)) if rng.random() < 0.9 else rng.choice(["no", "[1]", "3"]) for _ in range(rng.randint(1, 5))] for o in range(120)}
    rows = spark.createDataFrame([(o, i, t) for o, ts in owners.items() for i, t in enumerate(ts)], "owner long, layer int, config string")
    got = {}
    for r in settings.merged(rows).selectExpr("owner", "pointer", "to_json(value) as value").collect():
        got.setdefault(r["owner"], {})[r["pointer"]] = json.loads(r["value"])
    assert got == {o: flat(folded(ts)) for o, ts in owners.items() if flat(folded(ts))}


def test_types_and_defaults(spark):
    rows = spark.createDataFrame([("p", 0, '{"n": 5, "f": 2.5, "s": "7", "b": false, "neg": -1}'), ("q", 0, '{"n": "5", "f": 3, "s": 7, "b": 0}'), ("r", 0, None)], "owner string, layer int, config string")
    wanted = {"n": ("/n", "long", 9), "f": ("/f", "double", 0.5), "s": ("/s", "string", "z"), "b": ("/b", "boolean", True), "neg": ("/neg", "long", 4)}
    got = {r["owner"]: tuple(r)[1:] for r in settings.settings(settings.merged(rows), rows.select("owner"), wanted).collect()}
    assert got == {"p": (5, 2.5, "7", False, 4), "q": (9, 3.0, "z", True, 4), "r": (9, 0.5, "z", True, 4)}


def test_settings_of_the_command_line(spark):
    assert configured(spark) == Config()
    cfg = configured(spark, '{"bands": {"healthy": 10}, "history": {"max_commits": 5}}', ["/bands/watch=20", "/history/max_commits=7", '/inventory/ignore_globs=["*.x"]', "/scoring/weights=[0.5, 0.25, 0.25]", "/history/follow_renames=true"])
    assert (cfg.bands.healthy, cfg.bands.watch, cfg.max_commits, cfg.ignore_globs, cfg.weights, cfg.follow_renames) == (10, 20, 7, ("*.x",), (0.5, 0.25, 0.25), True)
    for wrong in (["/nothing=1"], ["/history/max_commits=-1"], ['/history/max_commits="1"'], ["/bands/healthy=9000"], ["/scoring/weights=[1]"]):
        with pytest.raises(ValueError):
            configured(spark, None, wrong)


def test_prefixes_that_fit(spark):
    rng = random.Random(5)
    files = [(f"p{i:05}", rng.choice([None, 0, 1, 10_000, 300_001])) for i in range(500)]
    rows = spark.createDataFrame(files, "path string, bytes long")

    def memory(k):
        b = sum(x or 0 for _, x in files[:k])
        return 3 * b + b // 2 + k * (20 * 256 + 5120) + 3 * 384 + (64 << 20)

    for limit in (0, memory(0), memory(1) - 1, memory(1), memory(250) + 1, memory(499), memory(500), 1 << 60):
        got, told = budget.fitting_prefix(rows, limit, 3)
        k = max([i for i in range(501) if memory(i) <= limit], default=0)
        assert told["n_paths"] == k and sorted(r["path"] for r in got.collect()) == [p for p, _ in files[:k]] and told["memory"] == memory(k)
    got, told = budget.fitting_prefix(rows.limit(0), 1 << 40, 0)
    assert told["n_paths"] == 0 and got.count() == 0
