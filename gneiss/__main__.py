"""Command line: analyse a Git repository, and read the runs it publishes."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from gneiss.config import Config, configured
from gneiss.operators import compare, evidence, health, lookup, scoring
from gneiss.session import local_session
from gneiss.sources import git, runs
from gneiss.sources.cache import Cache, cached_counts
from gneiss.staging import stage


def settings(spark, args) -> Config:
    text = None
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            text = f.read()
    return configured(spark, text, args.set)


def find(spark, args) -> int:
    from gneiss.functions.udfs import bpe_count
    from gneiss.functions.text import lines
    from gneiss.plans.analysis import analyze

    cfg = settings(spark, args)
    found = stage(git.read_files(spark, args.repo, cfg.large_file_bytes, args.scope, (*cfg.ignore_globs, *args.ignore)), "read-files")
    files = found.filter("state = 'analyzed'").withColumns({"lines": F.size(lines(F.col("text"))), "content": F.sha2("text", 256)})
    if args.cache:
        files = files.join(cached_counts(files.select("content", "text"), args.cache, bpe_count(), int(time.time()), "bpe", cfg.large_file_bytes), "content")
    else:
        files = files.withColumn("tokens", bpe_count()(F.col("text")))
    if found.isEmpty() and not args.allow_empty_scope:
        print("no tracked paths are selected; --allow-empty-scope accepts that", file=sys.stderr)
        return 2
    renames = args.follow_renames or cfg.follow_renames
    touches = git.read_touches(spark, args.repo, cfg.max_commits, renames=renames, bots=cfg.bots)
    if renames:
        touches = evidence.follow_renames(stage(touches, "read-touches"), found)
    run = analyze(files, touches, args.as_of or int(time.time()), cfg, reliable=not git.truncated(args.repo, cfg.max_commits))
    skipped = found.filter("state <> 'analyzed'").select("path", "state", "bytes")
    runs.publish({**run.tables(), "skipped": skipped}, args.runs, args.run_id or time.strftime("%Y%m%dT%H%M%S", time.gmtime()), run.limits(cfg))
    print(runs.markdown(run.queue.orderBy("position"), ["position", "path", "score", "severity"]))
    return 0


def table(spark, args, name):
    return runs.load(spark, args.runs, name, args.run_id)


def listed(spark, args) -> int:
    rows = lookup.matching(table(spark, args, args.table), args.path)
    for line in rows.limit(args.limit).toJSON().collect():
        print(line)
    return 0


def check(spark, args) -> int:
    failing = scoring.failing(table(spark, args, "files"), args.context, args.score).orderBy(F.desc("score"), F.desc("tokens"), "path")
    print(runs.markdown(failing, ["path", "score", "score_band", "context_band"], args.limit))
    return int(not failing.isEmpty())


def compared(spark, args) -> int:
    base, head = (runs.load(spark, args.runs, "files", r) for r in (args.base, args.head))
    worse = compare.regressions(compare.deltas(base, head), settings(spark, args))
    rows, told = compare.page_with_totals(worse, args.offset, args.limit, F.desc("score_delta"), F.asc("path"))
    print(runs.markdown(rows.orderBy("position"), ["path", "reason", "severity", "score_delta"], args.limit))
    print(f"{told['returned']} of {told['total']}" + (", more follow" if told["has_more"] else ""))
    return int(args.fail_on_regression and told["total"] > 0)


def healthy(spark, args) -> int:
    files = table(spark, args, "files")
    if args.format == "json":
        print(json.dumps(health.distribution(files).first().asDict()))
    elif args.format == "annotations":
        print("\n".join(runs.annotations(table(spark, args, "findings"), args.limit)))
    else:
        print(runs.markdown(health.by_language(files).orderBy(F.desc("tokens")), ["profile", "language", "n_files", "tokens", "share"], args.limit))
    return 0


def planned(spark, args) -> int:
    temporal = table(spark, args, "temporal").select("a", "b", F.lit("temporal").alias("kind"), F.col("evidence").alias("score"))
    edges = temporal.unionByName(table(spark, args, "duplicates").select("a", "b", "kind", "score"))
    for s in lookup.plan(table(spark, args, "files"), edges, args.path):
        print(f"{s.priority}: {s.title} ({s.score:.1f})\n  " + "\n  ".join(s.paths))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gneiss", description=__doc__)
    parser.add_argument("--runs", default=".gneiss/runs")
    parser.add_argument("--run-id")
    parser.add_argument("--limit", type=int, default=25)
    parser.add_argument("--config", help="a JSON file of settings")
    parser.add_argument("--set", action="append", default=[], metavar="POINTER=VALUE")
    commands = parser.add_subparsers(required=True)

    def command(name, run, *options):
        sub = commands.add_parser(name)
        for flags, kw in options:
            sub.add_argument(flags, **kw)
        sub.set_defaults(run=run)

    command(
        "find",
        find,
        ("--repo", {"default": "."}),
        ("--as-of", {"type": int}),
        ("--cache", {"help": "a folder of token counts to read and add to"}),
        ("--scope", {}),
        ("--ignore", {"action": "append", "default": []}),
        ("--follow-renames", {"action": "store_true"}),
        ("--allow-empty-scope", {"action": "store_true"}),
    )
    command("list", listed, ("table", {}), ("--path", {}))
    command("check", check, ("--context", {"default": "critical"}), ("--score", {"default": "critical"}))
    command("compare", compared, ("base", {}), ("head", {}), ("--offset", {"type": int, "default": 0}), ("--fail-on-regression", {"action": "store_true"}))
    command("health", healthy, ("--format", {"default": "markdown", "choices": ["markdown", "json", "annotations"]}))
    command("plan", planned, ("path", {}))
    command("sarif", lambda spark, a: print(runs.sarif(table(spark, a, "queue"))) or 0)
    command("prune-cache", lambda spark, a: print(json.dumps(Cache(spark, a.cache).prune(a.max_entries, a.max_bytes, a.dry_run))) or 0, ("cache", {}), ("--max-entries", {"type": int, "default": 100_000}), ("--max-bytes", {"type": int, "default": 1 << 30}), ("--dry-run", {"action": "store_true"}))
    command("prune", lambda spark, a: print(*runs.prune(spark, a.runs, a.max_runs, a.max_bytes), sep="\n") or 0, ("--max-runs", {"type": int, "default": 20}), ("--max-bytes", {"type": int, "default": 2 << 30}))
    args = parser.parse_args(argv)
    return args.run(local_session(name="gneiss"), args)


if __name__ == "__main__":
    sys.exit(main())
