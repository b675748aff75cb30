"""Duplicate and lexically close files among the largest candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gneiss.config import Config
from gneiss.functions import text as texts, udfs
from gneiss.functions.numeric import half_away
from gneiss.functions.paths import DERIVED, classification, root
from gneiss.plans.components import connected_components
from gneiss.session import shuffle_partitions
from gneiss.staging import stage


def candidates(files: DataFrame, cfg: Config) -> DataFrame:
    """The largest files by structural tokens that are not derived; cfg.candidate_limit is the operator's own, None takes all."""
    low, high = cfg.structural_tokens
    rows = files.select("path", "text", classification(F.col("path")).alias("classification"), F.size(texts.ascii_tokens(F.col("text"))).alias("n_tokens"))
    rows = rows.filter(~F.col("classification").isin(*DERIVED) & F.col("n_tokens").between(low, high))
    return rows if cfg.candidate_limit is None else rows.orderBy(F.desc("n_tokens"), "path").limit(cfg.candidate_limit)


def shingled(files: DataFrame, cfg: Config) -> DataFrame:
    """path, fingerprint and shingles of every file; each text is split into tokens once."""
    tokens = files.repartition(shuffle_partitions(files.sparkSession), "path").select("path", F.sha2("text", 256).alias("fingerprint"), texts.ascii_tokens(F.col("text")).alias("tokens"))
    rows = stage(tokens, "tokens").select("path", "fingerprint", texts.shingles(F.col("tokens"), cfg.shingle, cfg.step).alias("shingles"))
    return stage(rows, "shingles")


def duplicate_pairs(rows: DataFrame, cfg: Config) -> DataFrame:
    """(a, b), a < b: equal fingerprints, or similarity of shingle sets from min_similarity up.

    Pairs come from an inverted index of shingles, not from all pairs; sets of
    too different sizes are left out before the join.
    """
    sized = rows.withColumn("n", F.size("shingles"))
    index = sized.select("path", "n", F.explode("shingles").alias("shingle"))
    a, b = index.select(F.col("path").alias("a"), F.col("n").alias("na"), "shingle"), index.select(F.col("path").alias("b"), F.col("n").alias("nb"), "shingle")
    near = a.join(b, "shingle").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= cfg.min_similarity * F.greatest("na", "nb")))
    near = near.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    near = near.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity")).filter(F.col("similarity") >= cfg.min_similarity)
    prints = rows.select("path", "fingerprint")
    same = prints.select(F.col("path").alias("a"), "fingerprint").join(prints.select(F.col("path").alias("b"), "fingerprint"), "fingerprint").filter("a < b").select("a", "b")
    rows = near.join(same.withColumn("exact", F.lit(True)), ["a", "b"], "full_outer")
    exact = F.coalesce("exact", F.lit(False))
    return rows.select("a", "b", F.when(exact, "exact").otherwise("near").alias("kind"), half_away(F.when(exact, 1.0).otherwise(F.col("similarity"))).alias("score"), F.when(exact, "supported").otherwise("limited").alias("class"))


def exact_groups(files: DataFrame) -> DataFrame:
    """Groups of files with equal text: size and first path; reduced before the shuffle."""
    groups = files.groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
    return groups.filter("n_files > 1")


def clusters(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs: first member, size, edges and score min(edges / 5, 1)."""
    members = connected_components(pairs, "a", "b")
    sizes = members.groupBy("component").agg(F.count("*").alias("n_members"))
    edges = pairs.join(members, F.col("a") == F.col("node")).groupBy("component").agg(F.count("*").alias("n_edges"))
    return sizes.join(edges, "component").select("component", "n_members", "n_edges", F.least(F.col("n_edges") / 5, F.lit(1.0)).alias("score"))


def top_terms(files: DataFrame, cfg: Config) -> DataFrame:
    """(path, term, count, position): stems that occur twice or more, most frequent first, then by name."""
    terms = files.select("path", F.explode(udfs.term_counts(texts.UNHELPFUL)(F.lower("text"))).alias("t"))
    counts = terms.groupBy("path", F.col("t.term").alias("term")).agg(F.sum("t.n").alias("count")).filter("count >= 2")
    best = Window.partitionBy("path").orderBy(F.desc("count"), "term")
    return counts.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= cfg.top_terms)


def lexical_pairs(terms: DataFrame, cfg: Config, threshold: float = 0.35, limit: int = 100) -> DataFrame:
    """(a, b) in different roots whose rarer terms overlap; terms in more than a third of the files are left out.

    Two files without any rarer term count as equal, with support 0.
    """
    paths = terms.select("path").distinct()
    n = paths.count()
    rare = terms.filter(F.octet_length("term") >= 4)
    common = rare.groupBy("term").agg(F.count_distinct("path").alias("df")).filter(F.col("df") <= max(n // 3, 2))
    rare = rare.join(common, "term", "left_semi").select("path", "term")
    sizes = rare.groupBy("path").agg(F.count("*").alias("n"))
    a, b = rare.select(F.col("path").alias("a"), "term"), rare.select(F.col("path").alias("b"), "term")
    shared = a.join(b, "term").filter((F.col("a") < F.col("b")) & (root(F.col("a")) != root(F.col("b")))).groupBy("a", "b").agg(F.count("*").alias("support"))
    shared = shared.join(sizes.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    scored = shared.select("a", "b", "support", (F.col("support") / (F.col("na") + F.col("nb") - F.col("support"))).alias("similarity"))
    bare = paths.join(sizes, "path", "left_anti")
    empty = bare.select(F.col("path").alias("a"), F.lit(1).alias("k")).join(bare.select(F.col("path").alias("b"), F.lit(1).alias("k")), "k").filter((F.col("a") < F.col("b")) & (root(F.col("a")) != root(F.col("b"))))
    scored = scored.unionByName(empty.select("a", "b", F.lit(0).cast("long").alias("support"), F.lit(1.0).alias("similarity"))).filter(F.col("similarity") >= threshold)
    kind = F.when(F.col("similarity") >= 0.6, "limited").otherwise("low_support")
    return scored.orderBy(F.desc("similarity"), "a", "b").limit(limit).select("a", "b", "support", half_away(F.col("similarity")).alias("similarity"), kind.alias("class"))


def ranked_relationships(edges: DataFrame, limit: int = 20) -> DataFrame:
    """(path, a, b, kind, score, position, raw, suppressed): each path's strongest edges, ties by the edge's ends."""
    ends = edges.withColumn("path", F.explode(F.array("a", "b")))
    best = Window.partitionBy("path").orderBy(F.desc("score"), "kind", "a", "b")
    counts = ends.groupBy("path").agg(F.count("*").alias("raw"))
    kept = ends.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= limit)
    return kept.join(counts, "path").select("path", "a", "b", "kind", "score", "position", "raw", F.greatest(F.col("raw") - limit, F.lit(0)).alias("suppressed"))
