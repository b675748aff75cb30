"""Whether runs can be compared and enforced: consistency of their tables, blockers, and freshness; for many runs at once.

runs: run, analysis_status, omitted, profile, worktree_clean, has_compare_index,
has_policy_index. collections: run, collection, total, returned, truncated.
public and index: run, path, content, fingerprint, status, reason. evidence: run,
field, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fields in which a public record and the comparison index must agree.
FIELDS = ("content", "fingerprint", "status", "reason")
#: Reasons for which a skipped file is no gap.
EXPECTED = ("binary", "gitlink", "undecodable")
#: Seconds after which a run is old, and before which it is from the future.
OLD, AHEAD = 86_400, -300


def incomplete(status: Column, reason: Column) -> Column:
    """A record whose file should have been read and was not."""
    return ~F.coalesce((status == "analyzed") | ((status == "skipped") & F.coalesce(reason.isin(*EXPECTED), F.lit(False))), F.lit(False))


def reconciled(public: DataFrame, index: DataFrame) -> DataFrame:
    """(run, path, mismatches): what each public record and the index disagree in, empty where they agree.

    no_path and not_indexed stand alone; otherwise the names of FIELDS that
    differ, nulls being equal to nulls alone. One join, in one pass; of several
    index records of a path any that agrees will do.
    """
    known = index.filter("path is not null").select("run", "path", F.struct(*FIELDS).alias("told")).groupBy("run", "path").agg(F.collect_set("told").alias("told"))
    own = F.struct(*FIELDS)
    rows = public.join(known, ["run", "path"], "left")
    agrees = F.exists("told", lambda t: t.eqNullSafe(own))
    fields = F.filter(F.array(*[F.when(~F.element_at("told", 1)[f].eqNullSafe(F.col(f)), f) for f in FIELDS]), lambda x: x.isNotNull())
    found = F.when(F.col("path").isNull(), F.array(F.lit("no_path"))).when(F.col("told").isNull(), F.array(F.lit("not_indexed"))).when(agrees, F.array().cast("array<string>")).otherwise(fields)
    return rows.select("run", "path", found.alias("mismatches"))


def collection_blockers(runs: DataFrame, collections: DataFrame) -> DataFrame:
    """(run, code, pointer, n) of missing and incomplete collections: files and folders, of the indexes where there are any."""
    base = F.when(F.col("has_compare_index"), "compare_index/").otherwise("")
    wanted = F.concat(
        F.array(*[F.struct(F.concat(base, F.lit(c)).alias("collection"), F.lit("canonical_collection_incomplete").alias("code")) for c in ("files", "folders")]),
        F.when(F.col("has_policy_index"), F.array(*[F.struct(F.lit(f"policy_index/{c}").alias("collection"), F.lit("policy_index_incomplete").alias("code")) for c in ("files", "folders")])).otherwise(
            F.array().cast("array<struct<collection:string,code:string>>")
        ),
    )
    rows = runs.select("run", F.explode(wanted).alias("w")).select("run", "w.*").join(collections.withColumn("told", F.lit(True)), ["run", "collection"], "left")
    partial = F.coalesce("truncated", F.lit(False)) | F.col("total").isNull() | F.col("returned").isNull() | (F.col("total") != F.col("returned"))
    code = F.when(F.col("told").isNull(), "collection_metadata_missing").when(partial, F.col("code"))
    return rows.select("run", code.alias("code"), F.concat(F.lit("/collection_metadata/"), "collection").alias("pointer"), F.lit(1).cast("long").alias("n")).filter("code is not null")


def blockers(runs: DataFrame, collections: DataFrame, public: DataFrame, index: DataFrame, evidence: DataFrame, clean_worktree: bool = False, allow_incomplete: bool = False) -> DataFrame:
    """(run, code, pointer, n): what keeps each run from being compared; n is how many records a code stands for.

    allow_incomplete forgives gaps in the inventory and the evidence;
    clean_worktree asks for a run of a clean worktree. Runs without an index
    are judged by their public records, none of which is indexed then.
    """
    one = lambda when, code, pointer: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(pointer).alias("pointer")))
    compact = F.coalesce(F.col("profile") == "compact", F.lit(False))
    own = [
        one(F.coalesce(F.col("analysis_status"), F.lit("unknown")) != "complete", "analysis_incomplete", "/diagnostics/analysis/analysis_status"),
        one(F.coalesce("omitted", F.lit(0)) > 0, "inventory_paths_omitted", "/diagnostics/analysis/degraded_omitted_path_count"),
        one(compact & ~F.col("has_compare_index"), "comparison_index_missing", "/compare_index/files"),
        one(compact & ~F.col("has_policy_index"), "policy_index_missing", "/policy_index/files"),
    ]
    if clean_worktree:
        own.append(one(F.coalesce(~F.col("worktree_clean"), F.lit(False)), "dirty_worktree_baseline", "/repo/worktree_clean"))
    found = runs.select("run", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("x")).select("run", "x.code", "x.pointer", F.lit(1).cast("long").alias("n"))
    found = found.unionByName(collection_blockers(runs, collections))
    if not allow_incomplete:
        counts = inventory_gaps(runs, public, index)
        pointer = F.when(F.col("has_compare_index"), "/compare_index/files").otherwise("/files")
        gaps = counts.filter("n_incomplete + n_inconsistent > 0").select("run", F.lit("inventory_evidence_incomplete").alias("code"), pointer.alias("pointer"), F.col("n_incomplete").alias("n"))
        odd = counts.filter("n_inconsistent > 0").select("run", F.lit("comparison_index_inconsistent").alias("code"), F.lit("/compare_index/files").alias("pointer"), F.col("n_inconsistent").alias("n"))
        told = evidence.filter(F.col("status").startswith("incomplete_")).select("run", F.lit("evidence_incomplete").alias("code"), F.concat(F.lit("/evidence_completeness/"), "field").alias("pointer"), F.lit(1).cast("long").alias("n"))
        found = found.unionByName(gaps).unionByName(odd).unionByName(told.join(runs.select("run"), "run", "left_semi"))
    return found


def inventory_gaps(runs: DataFrame, public: DataFrame, index: DataFrame) -> DataFrame:
    """(run, has_compare_index, n_incomplete, n_inconsistent) of every run."""
    count = lambda rows, out: rows.groupBy("run").agg(F.count_if(incomplete(F.col("status"), F.col("reason"))).alias(out))
    odd = reconciled(public, index).groupBy("run").agg(F.count_if(F.size("mismatches") > 0).alias("n_inconsistent"))
    rows = runs.select("run", "has_compare_index").join(count(index, "of_index"), "run", "left").join(count(public, "of_public"), "run", "left").join(odd, "run", "left")
    gaps = F.coalesce(F.when(F.col("has_compare_index"), F.col("of_index")).otherwise(F.col("of_public")), F.lit(0))
    return rows.select("run", "has_compare_index", gaps.alias("n_incomplete"), F.coalesce("n_inconsistent", F.lit(0)).alias("n_inconsistent"))


def readiness(runs: DataFrame, collections: DataFrame, public: DataFrame, index: DataFrame, evidence: DataFrame, clean_worktree: bool = False, allow_incomplete: bool = False) -> DataFrame:
    """A row for each run: analysis_complete, inventory_complete, evidence_complete, comparison_ready and its codes, sorted."""
    found = blockers(runs, collections, public, index, evidence, clean_worktree, allow_incomplete).groupBy("run").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    gaps = inventory_gaps(runs, public, index).select("run", (F.col("n_incomplete") + F.col("n_inconsistent") == 0).alias("inventory_complete"))
    told = evidence.groupBy("run").agg(F.count_if(F.col("status").startswith("incomplete_")).alias("gaps"))
    rows = runs.select("run", F.coalesce(F.col("analysis_status") == "complete", F.lit(False)).alias("analysis_complete")).join(gaps, "run").join(told, "run", "left").join(found, "run", "left")
    return rows.select("run", "analysis_complete", "inventory_complete", (F.coalesce("gaps", F.lit(0)) == 0).alias("evidence_complete"), F.col("codes").isNull().alias("comparison_ready"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


#: Facts of a run that go stale, with the code of a change.
CHANGES = (("head", "head_changed"), ("worktree_digest", "worktree_changed"), ("version", "analyzer_changed"), ("config_digest", "config_changed"), ("path_digest", "scope_changed"))


def freshness(runs: DataFrame, now_facts: DataFrame, now: int) -> DataFrame:
    """(run, current, age_seconds, reasons): whether each run still describes its repository.

    runs: run, repo, the facts of CHANGES, degraded and generated_at (seconds);
    now_facts: repo and the same facts as they are now, config_digest null where
    the configuration cannot be read. Nulls equal nulls; a degraded run is not
    held against its scope.
    """
    rows = runs.join(now_facts.select("repo", F.lit(True).alias("known"), *[F.col(c).alias(f"now_{c}") for c, _ in CHANGES]), "repo", "left")
    tests = []
    for c, code in CHANGES:
        differs = ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
        if c == "config_digest":
            tests += [F.when(F.col("now_config_digest").isNull(), "config_unavailable").when(differs, code)]
        elif c == "path_digest":
            tests += [F.when(~F.coalesce("degraded", F.lit(False)) & differs, code)]
        else:
            tests += [F.when(differs, code)]
    age = F.lit(now) - F.col("generated_at")
    tests += [F.when(age.isNull(), "report_age_unknown").when(age > OLD, "report_too_old").when(age < AHEAD, "report_from_future")]
    reasons = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return rows.select("run", (F.size(reasons) == 0).alias("current"), age.alias("age_seconds"), reasons.alias("reasons"))
