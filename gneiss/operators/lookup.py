"""Reading one run: records, lists, explanations and bounded maintenance plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions.paths import in_scope, parent

#: Named pressures in the order in which equal ones are told.
PRESSURES = ("context_pressure", "age_pressure", "churn_pressure", "coordination", "blast_radius", "navigation", "stewardship", "gap", "dispersion")


def matching(rows: DataFrame, prefix: str | None = None, **values: str | list[str] | None) -> DataFrame:
    """Rows under a path prefix whose named columns have one of the values; None asks for nothing."""
    if prefix:
        rows = rows.filter(in_scope(F.col("path"), prefix))
    for column, wanted in values.items():
        if wanted is not None:
            rows = rows.filter(F.col(column).isin(*([wanted] if isinstance(wanted, str) else wanted)))
    return rows


def touching(edges: DataFrame, path: str) -> DataFrame:
    """Edges with an end at the path or below it, strongest first."""
    near = lambda c: in_scope(F.col(c), path)
    return edges.filter(near("a") | near("b")).withColumn("hits", near("a").cast("int") + near("b").cast("int")).orderBy(F.desc("hits"), F.desc("score"), "a", "b")


def by_id(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """The row with this id, or else the only one whose id starts so; none if there are several."""
    hits = rows.filter(F.col(key).startswith(prefix))
    count = hits.agg(F.count("*").alias("__n"), F.count_if(F.col(key) == prefix).alias("__e"))
    return hits.crossJoin(F.broadcast(count)).filter((F.col(key) == prefix) | ((F.col("__e") == 0) & (F.col("__n") == 1))).drop("__n", "__e")


def strongest(columns: list[str], limit: int = 3) -> Column:
    """Names of a row's largest positive pressures, largest first, ties in the given order."""
    items = F.array(*[F.struct((-F.coalesce(F.col(c), F.lit(0.0))).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    return F.transform(F.slice(F.sort_array(F.filter(items, lambda x: x["v"] < 0)), 1, limit), lambda x: x["name"])


def explain_top(rows: DataFrame, edges: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """The first n files by score with their strongest pressures and the number of their edges."""
    top = rows.orderBy(F.desc("score"), F.desc("tokens"), "path").limit(n)
    ends = edges.select(F.explode(F.array("a", "b")).alias("path")).groupBy("path").agg(F.count("*").alias("n_edges"))
    return top.join(ends, "path", "left").select("path", "score", "tokens", F.array_join(strongest(columns), ",").alias("pressures"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def folder_top(rows: DataFrame, folder: str) -> DataFrame:
    """The highest-ranked file below a folder."""
    return rows.filter(in_scope(F.col("path"), folder)).orderBy(F.desc("score"), F.desc("tokens"), "path").limit(1)


def anchor_scope(rows: DataFrame, edges: DataFrame, anchor: str, size: int = 5) -> DataFrame:
    """Paths of a plan around an anchor: itself, its strongest partners, then its folder's best, to the plan's size."""
    partners = edges.filter((F.col("a") == anchor) | (F.col("b") == anchor)).select(F.when(F.col("a") == anchor, F.col("b")).otherwise(F.col("a")).alias("path"), F.col("score").alias("weight"))
    near = partners.groupBy("path").agg(F.max("weight").alias("weight")).withColumn("rank", F.lit(1))
    own = rows.filter(F.col("path") == anchor).select("path", F.lit(0.0).alias("weight"), F.lit(0).alias("rank"))
    folder = anchor.rsplit("/", 1)[0] if "/" in anchor else "."
    beside = rows.filter((parent(F.col("path")) == folder) & (F.col("path") != anchor)).select("path", F.col("score").alias("weight"), F.lit(2).alias("rank"))
    found = own.unionByName(near).unionByName(beside).groupBy("path").agg(F.min(F.struct("rank", -F.col("weight"), "path")).alias("at"))
    return found.orderBy("at").limit(size).select("path", F.col("at.rank").alias("rank"))


@dataclass
class Slice:
    """A bounded piece of work: what it touches and why."""

    title: str
    paths: tuple[str, ...]
    score: float
    evidence: set[str] = field(default_factory=set)

    @property
    def priority(self) -> str:
        return "Now" if self.score >= 75 else "Next" if self.score >= 40 else "Later"


def merged(slices: list[Slice], limit: int) -> list[Slice]:
    """Slices of one scope become one; a slice inside another with at least its score goes; best first."""
    by_scope: dict[frozenset[str], Slice] = {}
    for s in sorted(slices, key=lambda s: (-s.score, s.title)):
        kept = by_scope.setdefault(frozenset(s.paths), s)
        kept.evidence |= s.evidence
    ranked = sorted(by_scope.values(), key=lambda s: (-s.score, len(s.paths), s.paths))
    out: list[Slice] = []
    for s in ranked:
        if not any(set(s.paths) < set(o.paths) and o.score >= s.score for o in ranked):
            out.append(s)
    return out[:limit]


def plan(rows: DataFrame, edges: DataFrame, anchor: str, max_slices: int = 3, size: int = 5) -> list[Slice]:
    """Slices for a file: its own scope, and one for each of its three strongest edges. Bounded, so built on the driver."""
    scope = [r["path"] for r in anchor_scope(rows, edges, anchor, size).collect()]
    if not scope:
        return []
    best = touching(edges, anchor).limit(3).collect()
    wanted = {anchor, *scope, *[p for e in best for p in (e["a"], e["b"])]}
    scores = {r["path"]: r["score"] for r in rows.filter(F.col("path").isin(*wanted)).select("path", "score").collect()}
    slices = [Slice(f"Work on {anchor}", tuple(scope), scores.get(anchor, 0.0), {"anchor"})]
    for e in best:
        ends = tuple(sorted((e["a"], e["b"])))
        slices.append(Slice(f"{e['kind']} pair {ends[0]} and {ends[1]}", ends, max(scores.get(p, 0.0) for p in ends), {e["kind"]}))
    return merged(slices, max_slices)
