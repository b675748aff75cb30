"""Git as a source: two readers for Spark, of the log by ranges of commits and of tracked files by ranges of paths.

The driver only counts; every partition runs git for its own range, reads what
it prints as it comes, and holds one commit or one file at a time. Executors
need the repository under the same path.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "%x00commit%x00%H%x00%ct%x00%an%x00%ae%x00%P%x00%s%x00"
TOUCH_SCHEMA = "commit_id string, seq long, ts long, author string, bot boolean, subject string, parents int, path string, status string, old_path string, added long, deleted long"
FILE_SCHEMA = "path string, state string, bytes long, text string, content string"
#: Commits, and paths, of a partition; rows and bytes of text of a batch.
COMMITS, PATHS, ROWS, BYTES = 2000, 2000, 1000, 8 << 20


def git(repo: str, *args: str) -> str:
    """Output of git; a path that is not UTF-8 is an error."""
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout.decode("utf-8")


def printed(repo: str, *args: str, end: bytes = b"\0") -> Iterator[bytes]:
    """What git prints, in pieces parted by end, as it prints them."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        rest = b""
        while chunk := run.stdout.read(1 << 16):
            *whole, rest = (rest + chunk).split(end)
            yield from whole
        if rest:
            yield rest
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, ["git", *args])


def tracked(repo: str, scope: str | None = None) -> Iterator[str]:
    """Tracked paths in the order of their bytes, under a folder if one is given; a path that is not UTF-8 is an error."""
    last = None
    for raw in printed(repo, "ls-files", "-z", *(["--", f":(literal){scope}"] if scope else [])):
        if raw and raw != last:
            yield raw.decode("utf-8").replace("\\", "/")
        last = raw


def tracked_paths(repo: str) -> list[str]:
    return sorted({p.replace("\\", "/") for p in git(repo, "ls-files", "-z").split("\0") if p}, key=str.encode)


def author_key(name: str, email: str) -> str:
    return f"{name.strip()} <{email.strip()}>"


@dataclass
class Entry:
    """One commit of a log: its header and the fields after it."""

    commit: str
    ts: int
    author: str
    parents: int
    subject: str
    fields: list[str]


def entries(blocks: Iterator[bytes]) -> Iterator[Entry]:
    """Commits of a NUL-delimited log, newest first, from what stands between their marks; an unreadable time is 0."""
    for block in blocks:
        commit, ts, name, email, parents, subject, *fields = block.decode("utf-8").split("\0")
        yield Entry(commit, int(ts) if ts.isdigit() else 0, author_key(name, email), len(parents.split()), subject, [f.lstrip("\n") for f in fields if f.strip("\n")])


def log_entries(repo: str, *args: str) -> Iterator[Entry]:
    """Commits of git log as it prints them."""
    blocks = printed(repo, "log", f"--format={FORMAT}", "-z", *args, end=b"\0commit\0")
    return entries(itertools.islice(blocks, 1, None))


def statuses(entry: Entry) -> Iterator[tuple[str, str, str | None]]:
    """(status, path, old path); renames and copies take two paths."""
    fields = iter(entry.fields)
    for status in fields:
        first = next(fields, None)
        if first is None:
            return
        if status[:1] in "RC":
            second = next(fields, None)
            if second is not None:
                yield status[0], second, first
        else:
            yield status[0], first, None


def numstats(entry: Entry) -> Iterator[tuple[int, int, str]]:
    """(added, deleted, path); binary entries are dropped, renames count for the new path."""
    fields = iter(entry.fields)
    for field in fields:
        parts = field.split("\t")
        if len(parts) < 3:
            continue
        path = parts[2]
        if not path:
            next(fields, None)
            path = next(fields, "")
        if parts[0].isdigit() and parts[1].isdigit() and path:
            yield int(parts[0]), int(parts[1]), path


def touch_rows(status_log: Iterator[Entry], numstat_log: Iterator[Entry], bots: tuple[str, ...], first: int = 0) -> Iterator[tuple]:
    """Rows of TOUCH_SCHEMA: every status change with the line counts of the same commit and path.

    Both logs hold the same commits in the same order; first is the place of
    the first of them.
    """
    for seq, (e, counts) in enumerate(zip(status_log, numstat_log, strict=True), first):
        if e.commit != counts.commit:
            raise ValueError(f"the log changed while it was read, at {e.commit}")
        churn = {p: (a, d) for a, d, p in numstats(counts)}
        bot = any(b in e.author.lower() for b in bots)
        for status, path, old in statuses(e):
            added, deleted = churn.get(path, (0, 0))
            yield e.commit, seq, e.ts, e.author, bot, e.subject, e.parents, path, status, old, added, deleted


def file_row(repo: str, path: str, max_bytes: int) -> tuple:
    """Row of FILE_SCHEMA: a symlink counts as its target's name, a file that is not read keeps the reason why."""
    from gneiss.functions.udfs import decode_of, looks_binary_of

    full = os.path.join(repo, path)
    if os.path.islink(full):
        data = os.readlink(full).encode()
        return path, "analyzed", len(data), data.decode(), hashlib.sha256(data).hexdigest()
    if os.path.isdir(full):
        return path, "gitlink", 0, None, None
    if not os.path.exists(full):
        return path, "missing", 0, None, None
    size = os.path.getsize(full)
    if size > max_bytes:
        return path, "too_large", size, None, None
    with open(full, "rb") as f:
        data = f.read()
    text = None if looks_binary_of(data) else decode_of(data)
    state = "binary" if looks_binary_of(data) else "undecodable" if text is None else "analyzed"
    return path, state, size, text, hashlib.sha256(data).hexdigest()


def batches(rows: Iterator[tuple], schema: T.StructType, sized: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ROWS rows and about BYTES bytes of the column numbered sized."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or "") if sized is not None else 0
        if len(held) == ROWS or size > BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)


class Range(InputPartition):
    def __init__(self, first: int, n: int):
        super().__init__(first)
        self.first, self.n = first, n


def parted(n: int, step: int) -> list[Range]:
    return [Range(a, min(step, n - a)) for a in range(0, n, step)] or [Range(0, 0)]


class LogReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.repo, self.schema = options["repo"], schema
        self.max_commits, self.step = int(options["max_commits"]), int(options["step"])
        self.chosen = ["-M" if options["renames"] == "true" else "--no-renames", *([f"--since={options['since']}"] if options.get("since") else []), options["head"]]
        self.bots = tuple(b for b in options["bots"].split("\0") if b)

    def partitions(self) -> list[Range]:
        return parted(commit_count(self.repo, self.max_commits, self.chosen[1:]), self.step)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.n:
            logs = [log_entries(self.repo, f"--skip={part.first}", f"--max-count={part.n}", kind, *self.chosen) for kind in ("--name-status", "--numstat")]
            yield from batches(touch_rows(*logs, self.bots, part.first), self.schema)


class FileReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.repo, self.schema, self.scope = options["repo"], schema, options.get("scope") or None
        self.max_bytes, self.step = int(options["max_bytes"]), int(options["step"])
        self.ignore = re.compile(options["ignore"]) if options.get("ignore") else None

    def partitions(self) -> list[Range]:
        return parted(sum(1 for _ in tracked(self.repo, self.scope)), self.step)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        paths = itertools.islice(tracked(self.repo, self.scope), part.first, part.first + part.n)
        rows = ((p, "ignored", 0, None, None) if self.ignore and self.ignore.search(p) else file_row(self.repo, p, self.max_bytes) for p in paths)
        yield from batches(rows, self.schema, 3)


class GitLog(DataSource):
    """Commits and the paths they touch."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return TOUCH_SCHEMA

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options, schema)


class GitFiles(DataSource):
    """Tracked files and their texts."""

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema: T.StructType) -> FileReader:
        return FileReader(self.options, schema)


def commit_count(repo: str, most: int, chosen: list[str]) -> int:
    """How many commits a log has, most at most."""
    return int(git(repo, "rev-list", "--count", f"--max-count={most}", *chosen))


def read_touches(spark: SparkSession, repo: str, max_commits: int = 10_000, since: str | None = None, renames: bool = False, bots: tuple[str, ...] = ("[bot]",), step: int = COMMITS) -> DataFrame:
    """The newest max_commits commits of a repository as one row a commit and path; truncated() tells whether there are more.

    Every partition reads step commits of the present head; that head is kept,
    so partitions that are read again, or late, see the same log.
    """
    spark.dataSource.register(GitLog)
    options = {"repo": os.path.abspath(repo), "max_commits": max_commits, "step": step, "renames": str(renames).lower(), "bots": "\0".join(bots), "head": git(repo, "rev-parse", "HEAD").strip()}
    return spark.read.format("git_log").options(**options, **({"since": since} if since else {})).load()


def truncated(repo: str, max_commits: int = 10_000, since: str | None = None) -> bool:
    """Whether a history has more commits than are read, so that its metrics are not reliable."""
    return commit_count(repo, max_commits + 1, [*([f"--since={since}"] if since else []), "HEAD"]) > max_commits


def read_files(spark: SparkSession, repo: str, max_bytes: int = 2 << 20, scope: str | None = None, ignore: tuple[str, ...] = (), step: int = PATHS) -> DataFrame:
    """Tracked files with path, state, bytes, text and content hash.

    Files that are not read stay, with the reason as their state: ignored (a
    glob matches, see paths.ignored), gitlink, missing, too_large, binary,
    undecodable. scope is a folder or file of the repository; one that leaves
    the repository is refused, one that selects nothing gives no rows.
    """
    from gneiss.functions.paths import clean_scope, ignore_pattern

    spark.dataSource.register(GitFiles)
    options = {"repo": os.path.abspath(repo), "max_bytes": max_bytes, "step": step, "scope": clean_scope(scope or "."), "ignore": ignore_pattern(ignore)}
    return spark.read.format("git_files").options(**options).load()


def clean_remote(url: str) -> str:
    """A remote's address without control characters, query, fragment and user; a local path becomes a hash."""
    url = re.sub(r"[\x00-\x1f\x7f]", "", url).split("#")[0].split("?")[0].strip()
    if re.match(r"^(/|\.|~|[A-Za-z]:[\\/]|file:)", url):
        return "local-" + hashlib.sha256(url.encode()).hexdigest()[:12]
    return re.sub(r"^([a-z+]+://)?[^/@]*@", r"\1", url)
