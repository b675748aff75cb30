"""The whole analysis of one repository as lazily evaluated tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gneiss.config import Config
from gneiss.functions.paths import is_test
from gneiss.operators import coupling, folders, health, history, inventory, overlays, provenance, scoring, similarity
from gneiss.staging import stage


@dataclass
class Analysis:
    """Tables of a run; each is a plan over the staged facts."""

    files: DataFrame
    folders: DataFrame
    queue: DataFrame
    commits: DataFrame
    temporal: DataFrame
    duplicates: DataFrame
    terms: DataFrame
    tests: DataFrame
    origins: DataFrame
    sources: DataFrame
    findings: DataFrame
    distribution: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))

    def limits(self, cfg: Config) -> dict[str, tuple[list, int]]:
        """The tables that a published run bounds, with their order and size."""
        return {"temporal": ([F.desc("evidence"), F.asc("a"), F.asc("b")], cfg.max_edges)}

    def relationships(self) -> DataFrame:
        """Edges of all kinds with one score."""
        temporal = self.temporal.select("a", "b", F.lit("temporal").alias("kind"), F.col("evidence").alias("score"), "class")
        return temporal.unionByName(self.duplicates.select("a", "b", "kind", "score", "class"))


def analyze(files: DataFrame, touches: DataFrame, now: int, cfg: Config | None = None, reliable: bool = True) -> Analysis:
    """files: path, bytes, lines, tokens, text; touches: one row a commit and path (see history). now is epoch seconds.

    Facts by file are staged once; everything else is derived from them.
    """
    cfg = cfg or Config()
    facts = inventory.inventory(files, cfg, marked=True)
    metrics = history.history_metrics(touches, facts, now, cfg).drop("lines", "tokens")
    seen = history.first_seen(touches, now).select("path", "age_days")
    commits = stage(history.commits(touches), "commits")
    edges = stage(coupling.pairs(touches, commits, cfg), "pairs")
    kept = coupling.neighbours(edges, cfg)
    coordination = coupling.coordination(touches, commits, cfg)
    n_files, n_commits = facts.count(), commits.count()
    spread = coupling.spread(kept, coordination, n_files)
    rows = facts.drop("text", "context_pressure").join(metrics, "path", "left").join(seen, "path", "left").fillna({"age_days": 0})
    rows = scoring.scored(rows, cfg, reliable)
    chosen = similarity.candidates(files, cfg)
    terms = stage(similarity.top_terms(files, cfg), "terms")
    for more in (spread, overlays.navigation(facts), overlays.stewardship(rows), overlays.dispersion(terms, n_files, cfg)):
        rows = rows.join(more, "path", "left")
    rows = stage(rows, "facts")
    origins, sources = (stage(t, "origins") for t in provenance.provenance(files.select("path", "text")))
    return Analysis(
        files=rows,
        folders=folders.rollup(rows, cfg),
        queue=scoring.observations(scoring.action_queue(rows)),
        commits=commits,
        temporal=coupling.temporal_edges(kept, coordination, n_commits, cfg),
        tests=overlays.test_mapping(facts.select("path"), terms=terms, mappings=cfg.source_test_mappings).filter(~is_test(F.col("path"))),
        origins=origins,
        sources=sources,
        duplicates=similarity.duplicate_pairs(similarity.shingled(chosen, cfg), cfg),
        terms=terms,
        findings=health.findings(rows, cfg),
        distribution=health.distribution(rows),
    )


def gate(run: Analysis, context: str = "critical", score: str = "critical") -> DataFrame:
    """Files that break the policy."""
    return scoring.failing(run.files, context, score)

