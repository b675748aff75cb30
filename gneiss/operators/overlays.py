"""Evidence per file: navigation, test adjacency, stewardship and dispersion of vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gneiss.config import Config
from gneiss.functions.numeric import clip, half_away
from gneiss.functions.paths import glob_regex, is_test, parent, root
from gneiss.functions.text import COMMON
from gneiss.staging import stage


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_stem(path: Column) -> Column:
    """The file's name to its first dot, without leading test_ and trailing _test, however often."""
    return F.regexp_replace(F.regexp_replace(F.split_part(file_name(path), F.lit("."), F.lit(1)), "^(test_)+", ""), "(_test)+$", "")


def navigation(files: DataFrame) -> DataFrame:
    """How hard a file is to find: its depth, its siblings, and how many files share its name."""
    rows = files.select("path", file_name(F.col("path")).alias("name"), parent(F.col("path")).alias("folder"), F.size(F.split("path", "/")).alias("depth"))
    names = rows.groupBy("name").agg(F.count("*").alias("same_name"))
    folders = rows.groupBy("folder").agg(F.count("*").alias("siblings"))
    rows = rows.join(names, "name").join(folders, "folder").withColumn("ambiguity", clip((F.col("same_name") - 1) / 5))
    pressure = clip((F.col("depth") - 1) / 8 * 0.35 + (F.col("siblings") - 1) / 30 * 0.35 + F.col("ambiguity") * 0.30)
    return rows.select("path", "depth", "siblings", "same_name", half_away(F.col("ambiguity")).alias("ambiguity"), half_away(pressure).alias("navigation"))


def containing(needles: DataFrame, tests: DataFrame, limit: int) -> DataFrame:
    """(needle, test) where a test's lower-cased path holds the needle, the first tests by path, at most limit a needle.

    Needles are of file names, so they hold no / and no dot, and a path holds
    one inside a part between those. Each distinct part is cut into all its
    substrings as long as some needle, and these are joined to the needles as
    wholes: what meets also matches, and rows grow with the parts alone. A test
    among a needle's first ones is among the first of each part that it shares.
    """
    lengths = needles.agg(F.collect_set(F.length("needle")).alias("lengths"))
    parts = tests.select("test", F.explode(F.array_distinct(F.split("low", "[/.]"))).alias("part"))
    first = Window.partitionBy("part").orderBy("test")
    few = parts.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= limit).select("part", "test")
    size = F.length("part")
    cut = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("part"), i, n))
    cuts = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= size), cut)))
    strings = few.select("part").distinct().join(F.broadcast(lengths)).select("part", F.explode(cuts).alias("needle"))
    held = strings.join(needles.select("needle").distinct().hint("merge"), "needle")
    best = Window.partitionBy("needle").orderBy("test")
    found = held.join(few.hint("merge"), "part").select("needle", "test").distinct()
    return found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= limit).select("needle", "test")


def uncommon(terms: DataFrame) -> DataFrame:
    """Distinct (path, term) without words that say nothing and those of one or two bytes."""
    return terms.select("path", "term").filter(~F.col("term").isin(*COMMON) & (F.octet_length("term") > 2)).distinct()


def sharing_two(files: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """(path, test): for each file the first tests by path that share two uncommon terms with it.

    Files and tests meet by pairs of terms, and of the tests of a pair only the
    first few go on: a test among a file's first ones is among the first of each
    pair that they share. So a pair that many hold makes no more rows than one
    that few hold. Terms that no test has are left out before they are paired.
    """
    kept = uncommon(terms)
    lists = lambda rows: rows.groupBy("path").agg(F.sort_array(F.collect_list("term")).alias("t"))
    twos = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    own = kept.join(files.filter(is_test(F.col("path"))).select("path"), "path", "left_semi")
    tests = lists(own).select(F.col("path").alias("test"), F.explode(twos).alias("two"))
    first = Window.partitionBy("two").orderBy("test")
    tests = tests.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= limit).select("two", "test")
    told = kept.join(files.select("path"), "path", "left_semi").join(own.select("term").distinct(), "term", "left_semi")
    found = lists(told).select("path", F.explode(twos).alias("two")).join(tests, "two").select("path", "test").distinct()
    best = Window.partitionBy("path").orderBy("test")
    return found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= limit).select("path", "test")


def test_mapping(files: DataFrame, limit: int = 5, terms: DataFrame | None = None, mappings: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(path, test, strength, position): the tests of a file, at most limit.

    Strength 0: a configured pair of globs (of files, of tests) says so. 1: the
    test's lower-cased path holds the file's name. 2: it holds the first long
    part of the name, where none holds all of it. 3: they share two uncommon
    terms (terms: path, term). A test counts with the first that holds; tests
    are ordered by strength and path. Equal names are matched once.
    """
    rows = files.select("path", F.lower(name_stem(F.col("path"))).alias("stem"))
    tests = files.filter(is_test(F.col("path"))).select(F.col("path").alias("test"), F.lower("path").alias("low"))
    prefix = F.coalesce(F.try_element_at(F.filter(F.split("stem", "_"), lambda p: F.octet_length(p) >= 5), F.lit(1)), F.lit(""))
    stems = rows.select("stem").distinct().withColumn("prefix", prefix)
    strong = containing(stems.filter("stem <> ''").select(F.col("stem").alias("needle")), tests, limit).select(F.col("needle").alias("stem"), "test", F.lit(1).alias("strength"))
    strong = stage(strong, "strong")
    others = stems.join(strong.select("stem").distinct().hint("merge"), "stem", "left_anti").filter("prefix <> ''")
    weak = others.hint("merge").join(containing(others.select(F.col("prefix").alias("needle")).distinct(), tests, limit), F.col("prefix") == F.col("needle")).select("stem", "test", F.lit(2).alias("strength"))
    found = strong.unionByName(weak)
    best = Window.partitionBy("stem").orderBy("strength", "test")
    found = found.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= limit)
    out = rows.join(found.hint("merge"), "stem").select("path", "test", "strength", "position")
    more = []
    if terms is not None:
        more.append(sharing_two(files, terms, limit).withColumn("strength", F.lit(3)))
    for source, test in mappings:
        matched = tests.filter(F.col("test").rlike(glob_regex(test))).select("test").orderBy("test").limit(limit)
        more.append(files.filter(F.col("path").rlike(glob_regex(source))).select("path").join(F.broadcast(matched)).withColumn("strength", F.lit(0)))
    if not more:
        return out
    out = out.select("path", "test", "strength")
    for part in more:
        out = out.unionByName(part.select("path", "test", "strength"))
    out = out.groupBy("path", "test").agg(F.min("strength").alias("strength"))
    order = Window.partitionBy("path").orderBy("strength", "test")
    return out.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def strongly_mapped(files: DataFrame, found: DataFrame, mappings: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(path, strong): whether a test holds a file's name, or a configured pair names the file, whatever tests that has."""
    named = found.filter("strength <= 1").select("path").distinct().withColumn("named", F.lit(True))
    told = F.lit(False)
    for source, _ in mappings:
        told = told | F.col("path").rlike(glob_regex(source))
    return files.select("path").join(named, "path", "left").select("path", (F.coalesce("named", F.lit(False)) | told).alias("strong"))


def verification_gap(facts: DataFrame) -> DataFrame:
    """facts (path, classification, score, inline_tests, strength, degree, test_neighbours) with adjacency and gap."""
    test = is_test(F.col("path"))
    near = F.col("inline_tests") | (F.col("strength") <= 1)
    adjacency = F.when(test | F.coalesce(near, F.col("inline_tests")), 1.0).when(F.col("strength").isNotNull(), 0.5).otherwise(0.0)
    ratio = F.coalesce(F.try_divide("test_neighbours", "degree"), F.lit(0.0))
    hot = ~test & ~F.col("inline_tests") & (F.col("score") >= 50) & F.col("strength").isNull()
    gap = F.when(F.col("inline_tests"), 0.0).otherwise(clip((1 - F.col("adjacency")) * 0.6 + (1 - clip(F.col("ratio"))) * 0.2 + F.when(hot, 0.2).otherwise(0.0)))
    rows = facts.withColumns({"adjacency": adjacency, "ratio": ratio})
    applies = F.col("classification").isin("source", "tool") & ~test
    return rows.select("path", "adjacency", half_away(F.col("ratio")).alias("test_ratio"), hot.alias("hotspot"), F.when(applies, half_away(gap)).alias("gap"))


def stewardship(history: DataFrame) -> DataFrame:
    """history with age_days: concentration of ownership, many hands and staleness, blended; 0 without authors."""
    rev = F.col("revisions")
    support, aged = rev / (rev + 5), clip(F.col("age_days") / 90)
    own = F.col("top_author_share") * support * aged
    many = clip(clip(F.col("author_entropy") / 4) * 0.6 + clip(F.col("n_authors") / 10) * 0.4)
    stale = clip(F.coalesce("days_since_human", F.lit(0)) / 365) * support
    return history.select("path", F.when(F.col("n_authors") > 0, half_away(clip(0.40 * own + 0.35 * many + 0.25 * stale))).otherwise(0.0).alias("stewardship"))


def term_stats(terms: DataFrame) -> DataFrame:
    """Documents and roots of every term."""
    return terms.groupBy("term").agg(F.count_distinct("path").alias("df"), F.count_distinct(root(F.col("path"))).alias("n_roots"))


def dispersion(terms: DataFrame, n_files: int, cfg: Config) -> DataFrame:
    """Share of a file's term weight in terms that wander over roots, and its rarest terms.

    Of the wandering terms the first top_terms by name count; both lists come
    from ranked rows, at most top_terms a file.
    """
    common = F.col("term").isin(*COMMON) | (F.octet_length("term") <= 2)
    rows = terms.join(term_stats(terms), "term").filter(~common)
    rows = rows.withColumn("idf", F.log(F.lit(n_files + 1.0) / (F.col("df") + 1)) + 1)
    wanders = (F.col("n_roots") > 1) & (F.col("df") <= max(n_files // 4, 2))
    by_name = Window.partitionBy("path").orderBy(F.col("wanders").desc(), "term")
    rare = Window.partitionBy("path").orderBy("df", "term")
    rows = rows.withColumn("wanders", wanders).withColumn("k", F.row_number().over(by_name)).withColumn("r", F.row_number().over(rare))
    counts = F.col("wanders") & (F.col("k") <= cfg.top_terms)
    return rows.groupBy("path").agg(
        F.count_if(counts).alias("n_drifting"),
        half_away(clip(F.coalesce(F.sum(F.when(counts, F.col("idf"))), F.lit(0.0)) / F.sum("idf"))).alias("dispersion"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= cfg.distinctive_terms, F.struct("r", "term")))), lambda x: x["term"]), ",").alias("distinctive"),
    )


def saturated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(overlay, n, verdict): overlays that say nothing, by saturation, range or entropy over ten bins; one pass over rows."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("overlay"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.overlay", "x.v").filter("v is not null")
    binned = stacked.groupBy("overlay", F.least(F.floor(F.col("v") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("c"), F.count_if(F.col("v") >= 0.999).alias("full"), F.min("v").alias("low"), F.max("v").alias("high"))
    totals = binned.groupBy("overlay").agg(F.sum("c").alias("n"))
    share = F.col("c") / F.col("n")
    out = binned.join(totals, "overlay").groupBy("overlay", "n").agg(F.sum("full").alias("full"), (F.max("high") - F.min("low")).alias("range"), (-F.sum(share * F.log2(share))).alias("bits"))
    verdict = F.when(F.col("n") < 10, "kept").when(F.col("full") >= 0.9 * F.col("n"), "saturated").when(F.col("range") < 0.01, "flat").when(F.col("bits") < 0.2, "low_entropy").otherwise("kept")
    return out.select("overlay", "n", verdict.alias("verdict"))
