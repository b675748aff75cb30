"""Commands that verify a file: from the manifests in the folders above it, from configuration and from what is near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gneiss.functions.paths import ancestors, glob_regex, parent

#: Manifests in the order in which the first one present decides, with their commands.
MANIFESTS = (
    ("Cargo.toml", ("cargo fmt --all -- --check", "cargo clippy --all-targets --all-features -- -D warnings", "cargo test --all-targets")),
    ("go.mod", ("go test ./...",)),
    ("pyproject.toml", ("pytest",)),
    ("package.json", ("npm test",)),
    ("pom.xml", ("mvn test",)),
    ("gradlew", ("./gradlew test",)),
    (".sln .csproj", ("dotnet test",)),
    ("Makefile", ("make test",)),
)
#: Lock files that choose the runner of a package.json.
RUNNERS = (("bun.lock", "bun test"), ("bun.lockb", "bun test"), ("pnpm-lock.yaml", "pnpm test"), ("yarn.lock", "yarn test"))
NAMES = [m for m, _ in MANIFESTS if " " not in m] + [lock for lock, _ in RUNNERS]
DOTNET = "(sln|csproj)"


def command_family(command: Column) -> Column:
    """What a command runs, whatever its options and folder: cargo test, npm test, pytest, or else itself."""
    last = F.trim(F.element_at(F.split(command, "&&"), -1))
    words = F.split(last, r"\s+")
    first, second = words[0], F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))
    pair = F.concat_ws(" ", first, second)
    known = ((first == "cargo") & second.isin("fmt", "clippy", "test")) | (first.isin("bun", "npm", "pnpm", "yarn", "go", "mvn", "dotnet") & (second == "test"))
    return F.when(known, pair).when(first == "pytest", "pytest").otherwise(last)


def folder_commands(files: DataFrame) -> DataFrame:
    """(folder, k, command) of every folder that holds a manifest; k orders the commands of one."""
    name = F.element_at(F.split("path", "/"), -1)
    held = files.select(parent(F.col("path")).alias("folder"), F.when(name.isin(*NAMES), name).when(name.rlike(rf"\.{DOTNET}$") & ~name.rlike(rf"^\.{DOTNET}$"), ".sln .csproj").alias("name"))
    held = held.filter("name is not null").groupBy("folder").agg(F.collect_set("name").alias("names"))
    has = lambda n: F.array_contains("names", n)
    commands = None
    for manifest, found in MANIFESTS:
        value = F.array(*map(F.lit, found))
        if manifest == "package.json":
            runner = F.lit(found[0])
            for lock, command in reversed(RUNNERS):
                runner = F.when(has(lock), command).otherwise(runner)
            value = F.array(runner)
        commands = F.when(has(manifest), value) if commands is None else commands.when(has(manifest), value)
    rows = held.select("folder", F.posexplode(commands).alias("k", "command"))
    return rows.withColumn("command", F.when(F.col("folder") == ".", F.col("command")).otherwise(F.concat(F.lit("cd "), "folder", F.lit(" && "), "command")))


def discovered(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, depth, k, command): the commands of every folder above a path, the outermost first.

    Folders meet paths by equality; the top folder, which is above all, has a
    few rows that go everywhere.
    """
    commands = folder_commands(files)
    top = commands.filter("folder = '.'").select(F.lit(0).alias("depth"), "k", "command")
    above = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder")).filter("depth > 0")
    nested = above.join(commands.filter("folder <> '.'"), "folder").select("path", "depth", "k", "command")
    return nested.unionByName(paths.select("path").join(F.broadcast(top)).select("path", "depth", "k", "command"))


def verification_commands(paths: DataFrame, files: DataFrame, configured: tuple[str, ...] = (), by_path: tuple[tuple[str, str], ...] = (), generated: DataFrame | None = None, nearby: DataFrame | None = None) -> DataFrame:
    """(path, command, position): what verifies each path, in order.

    First the configured commands, then those of the manifests above the path
    whose family is not configured, then those configured for paths by glob,
    then what checks a generated file (generated: path, verification_command),
    then the test targets near it (nearby: path, test). A command counts once.
    """
    spark = paths.sparkSession
    given = [c for c in configured if c.strip()]
    stages = []
    found = discovered(paths, files).withColumn("family", command_family(F.col("command")))
    if given:
        told = spark.createDataFrame([(i, c) for i, c in enumerate(given)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("command", T.StringType())]))
        found = found.join(F.broadcast(told.select(command_family(F.col("command")).alias("family"))), "family", "left_anti")
        stages.append(paths.select("path").join(F.broadcast(told)).select("path", F.lit(0).alias("stage"), F.lit(0).alias("depth"), "k", "command"))
    stages.append(found.select("path", F.lit(1).alias("stage"), "depth", "k", "command"))
    for i, (glob, command) in enumerate(by_path):
        if command.strip():
            stages.append(paths.filter(F.col("path").rlike(glob_regex(glob))).select("path", F.lit(2).alias("stage"), F.lit(0).alias("depth"), F.lit(i).alias("k"), F.lit(command).alias("command")))
    if generated is not None:
        checks = paths.select("path").join(generated.filter("trim(verification_command) <> ''"), "path")
        stages.append(checks.select("path", F.lit(3).alias("stage"), F.lit(0).alias("depth"), F.lit(0).alias("k"), F.col("verification_command").alias("command")))
    if nearby is not None:
        targets = paths.select("path").join(nearby, "path").withColumn("name", F.regexp_extract("test", r"^tests/([^/]*)\.rs$", 1)).filter(F.col("test").rlike(r"^tests/[^/]*\.rs$"))
        order = F.row_number().over(Window.partitionBy("path").orderBy("test"))
        stages.append(targets.select("path", F.lit(3).alias("stage"), F.lit(1).alias("depth"), order.alias("k"), F.concat(F.lit("cargo test --test "), "name").alias("command")))
    rows = stages[0]
    for more in stages[1:]:
        rows = rows.unionByName(more)
    first = rows.groupBy("path", "command").agg(F.min(F.struct("stage", "depth", "k")).alias("at"))
    return first.select("path", "command", F.row_number().over(Window.partitionBy("path").orderBy("at", "command")).alias("position"))
