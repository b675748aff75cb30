"""Queries over change history, scores, folders and coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gneiss.functions import paths
from gneiss.functions.numeric import half_even
from gneiss.operators import coupling, folders, health, history as ops, overlays, scoring
from gneiss.queries.facts import BAND, CLASS
from gneiss.queries.registry import BASE, CFG, NOW, query
from gneiss.sources import fixtures as fx
from gneiss.staging import stage

SINCE = NOW - CFG.window_days * 86_400
R6 = lambda x: f"round_even(({x}) * 1e6, 0) / 1e6"
A6 = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
CHURN = f"""{BASE}, dens as (select path, lines, tokens, greatest(tokens / greatest(lines, 1)::double, 1.0) as d from tracked),
cp as (select t.commit_id, t.path, max(ts) as ts, max(author) as author, bool_or(bot) as bot, sum(added)::bigint as added, sum(deleted)::bigint as deleted, sum(added + deleted)::bigint as churn, sum(round_even((added + deleted) * d, 0))::bigint as token_churn from touches t join dens using (path) group by 1, 2),
win as (select * from cp where ts >= {SINCE})"""
AUTHORS = f"""{CHURN}, ac as (select path, author, count(*) as c from win group by 1, 2), an as (select *, sum(c) over (partition by path)::double as n from ac),
authors as (select path, count(*) as n_authors, {R6("-sum(c / n * log2(c / n))")} as author_entropy, {R6("max(c / n)")} as top_author_share from an group by 1)"""
METRICS = f"""{AUTHORS}, m as (select path, count(*) as revisions, sum(added)::bigint as added, sum(deleted)::bigint as deleted, sum(churn)::bigint as churn, sum(token_churn)::bigint as token_churn,
{R6(f"sum(1 / (1 + (case when ts = 0 then 0.0 else greatest({NOW} - ts, 0) / 86400.0::double end) / 30))")} as recency,
{R6(f"coalesce(sum(token_churn) filter (ts <> 0 and ts >= {NOW - 30 * 86400}), 0) / greatest(sum(token_churn), 1)::double")} as late_spike,
count(distinct author) filter (ts >= {NOW - 90 * 86400}) as maintainers, floor(({NOW} - max(ts) filter (not bot and ts > 0)) / 86400.0)::bigint as days_since_human from win group by 1),
metrics as (select k.path, k.lines, k.tokens, coalesce(revisions, 0) as revisions, coalesce(added, 0) as added, coalesce(deleted, 0) as deleted, coalesce(churn, 0) as churn, coalesce(token_churn, 0) as token_churn, coalesce(recency, 0.0) as recency, coalesce(late_spike, 0.0) as late_spike,
 coalesce(maintainers, 0) as maintainers, days_since_human, coalesce(n_authors, 0) as n_authors, coalesce(author_entropy, 0.0) as author_entropy, coalesce(top_author_share, 0.0) as top_author_share, {R6("coalesce(churn, 0) / greatest(k.lines, 1)::double")} as relative_churn
 from tracked k left join m using (path) left join authors using (path)),
seen as (select path, coalesce(max_by(ts, seq) filter (status = 'A'), max_by(ts, seq)) as first_seen from touches group by 1),
aged as (select path, first_seen, floor(greatest({NOW} - first_seen, 0) / 86400.0)::bigint as age_days from seen)"""
SCORED = f"""{METRICS}, f0 as (select m.*, k.bytes, coalesce(age_days, 0) as age_days from metrics m join tracked k using (path) left join aged using (path)),
p as (select greatest(quantile_disc(revisions, 0.95)::double, 1.0) as rp, quantile_disc(relative_churn, 0.95) as cp from f0),
f1 as (select f0.*, least(revisions / 5.0::double, 1.0) as support, rp, case when cp > 0 then cp else 1.0 end as cd from f0, p),
f2 as (select *, least(tokens / 800.0::double, 1.0) as ctx, (1 - pow(2.0::double, -age_days / 180.0::double)) * support as ap, least(revisions / rp, 1.0) * support as rn, least(relative_churn / cd, 1.0) * support as cn from f1),
f3 as (select *, 0.6::double * rn + 0.4::double * cn as ch from f2),
f4 as (select *, round_even(100 * (0.6::double * ctx + 0.2::double * ap + 0.2::double * ch) * 10, 0) / 10 as score, {R6("ap")} as age_pressure, {R6("rn")} as revision_norm, {R6("cn")} as churn_norm, {R6("ch")} as churn_pressure, {BAND} as context_band, {CLASS} as classification from f3),
scored as (select *, case when score >= 85 then 'critical' when score >= 65 then 'high' when score >= 50 then 'moderate' else 'low' end as score_band,
 list_filter([case when context_band = 'critical' then 'critical_token_cost' end, case when context_band = 'warning' then 'high_token_cost' end, case when support >= 1 and age_days >= 180 then 'old_file' end, case when support >= 1 and revision_norm >= 0.8 then 'high_revision_frequency' end,
 case when support >= 1 and churn_norm >= 0.8 then 'high_relative_churn' end, case when support >= 1 and age_days >= 180 and churn_pressure >= 0.6 then 'old_and_volatile' end], lambda x: x is not null) as reasons from f4)"""
QUEUE = f"""{SCORED}, queue as (select *, row_number() over (order by score desc, tokens desc, path) as position,
 case when context_band = 'critical' or score_band = 'critical' then 'error' when context_band = 'warning' or score_band = 'high' then 'warning' else 'notice' end as severity,
 len(reasons) > 0 and len(list_filter(reasons, lambda x: x not in ('critical_token_cost', 'high_token_cost'))) = 0 as pure_context, case when revisions >= 5 then 'supported' else 'low_support' end as evidence
 from scored where len(reasons) > 0 or context_band in ('warning', 'critical') or score_band in ('high', 'critical'))"""


def metrics(spark, sf_dir) -> DataFrame:
    return ops.history_metrics(fx.touches(spark, sf_dir), fx.tracked(spark, sf_dir), NOW, CFG)


def scored(spark, sf_dir) -> DataFrame:
    """Tracked files with history, age, class and score."""
    touches, tracked = stage(fx.touches(spark, sf_dir), "touches"), fx.tracked(spark, sf_dir)
    rows = ops.history_metrics(touches, tracked, NOW, CFG).join(tracked.select("path", "bytes"), "path").join(ops.first_seen(touches, NOW).select("path", "age_days"), "path", "left").fillna({"age_days": 0})
    return scoring.scored(stage(rows.withColumn("classification", paths.classification(F.col("path"))), "facts"), CFG)


@query(f"{CHURN} select * from cp")
def commit_path_churn(spark, sf_dir):
    return ops.commit_path_churn(fx.touches(spark, sf_dir), fx.tracked(spark, sf_dir))


@query(f"{METRICS} select * from metrics")
def history_metrics(spark, sf_dir):
    return metrics(spark, sf_dir)


@query(f"{AUTHORS} select * from authors")
def author_stats(spark, sf_dir):
    return ops.author_stats(ops.commit_path_churn(fx.touches(spark, sf_dir), fx.tracked(spark, sf_dir)), SINCE)


@query(f"{METRICS} select * from aged")
def first_seen(spark, sf_dir):
    return ops.first_seen(fx.touches(spark, sf_dir), NOW)


COMMITS = f"""{BASE}, bp as (select commit_id, path, max(ts) as ts, max(subject) as subject, max(parents) as parents, max(status) as status, sum(added + deleted)::bigint as churn from touches group by 1, 2), sh as (select *, churn / nullif(sum(churn) over (partition by commit_id), 0)::double as s from bp),
c0 as (select commit_id, max(ts) as ts, max(subject) as subject, max(parents) as parents, count(*) as n_files, count(distinct split_part(path, '/', 1)) as n_roots, count(*) filter (status = 'A') as n_added, count(*) filter (regexp_matches(lower(path), '\\.lock$|-lock\\.json$|generated|snapshot|vendor/')) as n_mechanical,
 sum(ceil(greatest(churn, 1) / 20.0))::bigint as hunks, {A6("coalesce(-sum(case when s > 0 then s * log2(s) end), 0.0)")} as entropy from sh group by 1),
c1 as (select *, case when parents > 1 then 'merge' when regexp_matches(lower(subject), 'release|^bump version|^chore: version') then 'release' when (n_files >= 20 and 4 * n_added >= 3 * n_files) or (n_files >= 10 and n_mechanical >= 0.8 * n_files) or regexp_matches(lower(subject), 'import|vendor|generated snapshot') then 'import'
 when n_added >= n_files then 'creation' else 'maintenance' end as kind from c0),
commits as (select *, {R6("case when kind in ('merge', 'import') then 0.0 when kind = 'release' then 0.1::double / sqrt(greatest(n_files - 1, 1)) else 1.0::double / sqrt(greatest(n_files - 1, 1)) end")} as weight,
 0.35::double * least(ln(1.0::double + n_files) / ln(25.0::double), 1.0) + 0.25::double * least(ln(1.0::double + hunks) / ln(50.0::double), 1.0) + 0.20::double * least(ln(1.0::double + n_roots) / ln(10.0::double), 1.0) + 0.20::double * least(entropy / 3, 1.0) as diffusion from c1)"""


@query(f"{COMMITS} select commit_id, kind, n_files, n_roots, n_added, weight from commits")
def change_kind(spark, sf_dir):
    return ops.commits(fx.touches(spark, sf_dir)).select("commit_id", "kind", "n_files", "n_roots", "n_added", "weight")


@query(f"{COMMITS} select commit_id, hunks, entropy, {R6('diffusion')} as diffusion from commits")
def diffusion(spark, sf_dir):
    return ops.commits(fx.touches(spark, sf_dir)).select("commit_id", "hunks", "entropy", half_even(F.col("diffusion")).alias("diffusion"))


@query(f"{COMMITS} select quantile_disc(n_files, 0.95)::double as files_p95, quantile_disc(n_files, 0.99)::double as files_p99, quantile_disc(n_roots, 0.95)::double as roots_p95, quantile_disc(hunks, 0.95)::double as hunks_p95, quantile_disc(entropy, 0.95) as entropy_p95 from commits")
def commit_baselines(spark, sf_dir):
    return ops.commit_baselines(ops.commits(fx.touches(spark, sf_dir)))


@query(f"{SCORED} select path, tokens, age_days, revisions, score, score_band, context_band, age_pressure, revision_norm, churn_norm, churn_pressure from scored")
def pressure_score(spark, sf_dir):
    return scored(spark, sf_dir).select("path", "tokens", "age_days", "revisions", "score", "score_band", "context_band", "age_pressure", "revision_norm", "churn_norm", "churn_pressure")


@query(f"{SCORED} select path, array_to_string(reasons, ',') as reasons from scored")
def reason_codes(spark, sf_dir):
    return scored(spark, sf_dir).select("path", F.array_join("reasons", ",").alias("reasons"))


@query(f"{QUEUE} select position, path, score, score_band, context_band, tokens, severity, pure_context, evidence, array_to_string(reasons, ',') as reasons from queue")
def action_queue(spark, sf_dir):
    rows = scoring.action_queue(scored(spark, sf_dir))
    return rows.select("position", "path", "score", "score_band", "context_band", "tokens", "severity", "pure_context", "evidence", F.array_join("reasons", ",").alias("reasons"))


@query(f"{QUEUE} select path, position, classification = 'source' and (evidence = 'supported' or pure_context) and severity in ('warning', 'error') as intervention from queue")
def observation_feed(spark, sf_dir):
    return scoring.observations(scoring.action_queue(scored(spark, sf_dir))).select("path", "position", "intervention")


@query(f"{SCORED} select path, score, tokens, row_number() over (order by score desc, tokens desc, path) as position from scored order by score desc, tokens desc, path limit 25")
def ranked_files(spark, sf_dir):
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("tokens"), F.asc("path")]
    return scored(spark, sf_dir).orderBy(*order).limit(25).withColumn("position", F.row_number().over(Window.orderBy(*order))).select("path", "score", "tokens", "position")


@query(f"{SCORED} select path, score_band, context_band, classification from scored where classification not in ('generated', 'vendored', 'snapshot', 'fixture', 'migration_fixture') and (context_band in ('warning', 'critical') or score_band in ('high', 'critical'))")
def policy_failures(spark, sf_dir):
    return scoring.failing(scored(spark, sf_dir), "warning", "high").select("path", "score_band", "context_band", "classification")


@query(f"{SCORED} select path, classification, score from scored where (path like 'src/FRANCE/%' or path like 'src/C%') and classification = 'source' and score_band <> 'low'")
def list_filtered(spark, sf_dir):
    path = F.col("path")
    rows = scored(spark, sf_dir).filter((paths.in_scope(path, "src/FRANCE") | path.startswith("src/C")) & (F.col("classification") == "source") & (F.col("score_band") != "low"))
    return rows.select("path", "classification", "score")


@query(f"""{SCORED} select path, case when context_band = 'critical' or score_band = 'critical' then 'error' when context_band = 'warning' or score_band = 'high' then 'warning' else 'notice' end as severity,
case when context_band = 'critical' then 'Context budget exceeded' when context_band = 'warning' then 'Context budget warning' when score_band in ('high', 'critical') then 'High maintenance pressure' else 'Context headroom is narrowing' end as title, tokens, score
from scored where classification = 'source' and (context_band in ('warning', 'critical') or score_band in ('high', 'critical') or (context_band = 'healthy' and tokens >= 192))""")
def findings(spark, sf_dir):
    return health.findings(scored(spark, sf_dir), CFG).drop("message")


FOLDERS = f"""{SCORED}, ex as (select *, unnest(['.', 'src', regexp_extract(path, '^(.*)/[^/]*$', 1)]) as folder from scored), fo as (select folder, count(*) as n_files, count(*) filter (folder = regexp_extract(path, '^(.*)/[^/]*$', 1)) as n_direct, sum(tokens)::bigint as tokens, sum(bytes)::bigint as bytes,
 coalesce(sum(tokens) filter (folder = regexp_extract(path, '^(.*)/[^/]*$', 1)), 0)::bigint as direct_tokens, max(tokens) as largest, sum(revisions)::bigint as revisions, {R6("avg(churn_pressure)")} as volatility, case when count(distinct classification) = 1 then min(classification) else 'mixed' end as classification from ex group by 1),
tp as (select folder, path as top_file, score, score_band from ex qualify row_number() over (partition by folder order by score desc, tokens desc, path) = 1)"""


@query(f"""{FOLDERS} select folder, n_files, n_direct, tokens, direct_tokens, revisions, volatility, top_file, score, score_band, classification, {BAND} as context_band, {R6("least(tokens / 800.0::double, 1.0)")} as context_pressure, {R6("largest / greatest(tokens, 1)::double")} as top_share from fo join tp using (folder)""")
def folder_rollup(spark, sf_dir):
    rows = folders.rollup(scored(spark, sf_dir), CFG)
    return rows.select("folder", "n_files", "n_direct", "tokens", "direct_tokens", "revisions", "volatility", "top_file", "score", "score_band", "classification", "context_band", "context_pressure", "top_share")


@query(f"{FOLDERS} select folder, case when direct_tokens > 256000 or n_direct > 37 then 'budget_exceeded' when direct_tokens > 128000 or n_direct > 17 then 'warning' when direct_tokens > 31999 then 'healthy' else 'compact' end as health_band from fo")
def folder_bands(spark, sf_dir):
    return folders.rollup(scored(spark, sf_dir), CFG).select("folder", "health_band")


@query(f"""{FOLDERS}, rk as (select folder, tokens, row_number() over (partition by folder order by tokens desc, path) as k from ex) select folder, {R6("sum(tokens) filter (k <= 3) / greatest(sum(tokens), 1)::double")} as top_3_share from rk group by 1""")
def folder_costs(spark, sf_dir):
    return folders.three_largest(scored(spark, sf_dir))


@query(f"""{FOLDERS}, rr as (select folder, score, tokens, path, unnest(reasons) as reason, generate_subscripts(reasons, 1) as place from ex), first as (select folder, reason, row_number() over (partition by folder, reason order by score desc, tokens desc, path, place) as k, score, tokens, path, place from rr)
select folder, string_agg(reason, ',' order by score desc, tokens desc, path, place) as reasons from first where k = 1 group by 1""")
def folder_reasons(spark, sf_dir):
    return folders.reasons_in_rank_order(scored(spark, sf_dir))


PAIRS = f"""{COMMITS}, used as (select * from commits where kind not in ('merge', 'import') and n_files <= 200), tp as (select distinct t.commit_id, path, kind, weight from touches t join used using (commit_id)),
edges as (select a.path as a, b.path as b, count(*) as support, {A6("sum(a.weight)")} as weighted, count(*) filter (a.kind = 'creation') as creation, count(*) filter (a.kind <> 'creation') as maintenance from tp a join tp b on a.commit_id = b.commit_id and a.path < b.path group by 1, 2)"""
FACTS = f"""{PAIRS}, pc as (select t.commit_id, path, sum(added + deleted) as churn from touches t group by 1, 2), cf as (select path, count(*) as n_commits, count(*) filter (kind = 'creation') as n_creation, count(*) filter (kind in ('maintenance', 'release')) as n_maintenance, sum(n_files)::bigint as files, sum(n_roots)::bigint as roots, sum(ceil(greatest(churn, 1) / 20.0))::bigint as hunks,
 sum(diffusion * greatest(least(weight, 1.0), 0.0)) as d from pc join used using (commit_id) group by 1), facts as (select * exclude (d), {A6("d / n_commits * (n_commits / (n_commits + 5)::double)")} as change_diffusion from cf),
nb as (select *, row_number() over (partition by src order by support desc, dst) as position from (select a as src, b as dst, support, weighted from edges union all select b, a, support, weighted from edges)), kept as (select * from nb where position <= 20)"""


def coupled(spark, sf_dir, *facts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Touches, commits (with the named facts, or all) and pairs; many touches are spread by commit once for each, in tasks of bounded size."""
    touches = fx.spread(stage(fx.touches(spark, sf_dir).drop("seq", "author", "bot"), "touches"), "commit_id")
    commits = ops.commits(touches)
    commits = stage(commits.select("commit_id", *facts) if facts else commits, "commits")
    return touches, commits, coupling.pairs(touches, commits, CFG)


def edges(spark, sf_dir) -> DataFrame:
    """Pairs of paths, from commits of which only what pairs need is made."""
    return coupled(spark, sf_dir, "kind", "n_files", "weight")[2]


@query(f"{PAIRS} select * from edges")
def cochange_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"{FACTS} select * from kept")
def neighbors_top20(spark, sf_dir):
    return coupling.neighbours(edges(spark, sf_dir), CFG)


@query(f"{FACTS} select * from facts")
def coordination_facts(spark, sf_dir):
    touches, commits, _ = coupled(spark, sf_dir)
    return coupling.coordination(touches, commits, CFG)


TEMPORAL = f"""{FACTS}, once as (select least(src, dst) as a, greatest(src, dst) as b, arg_min(support, src) as support, arg_min(weighted, src) as weighted from kept group by 1, 2), n as (select count(*)::double as n from commits),
e as (select o.a, o.b, support, weighted, x.n_commits as ca, y.n_commits as cb, greatest(x.n_commits + y.n_commits - support, 1) as u, n from once o join facts x on x.path = o.a join facts y on y.path = o.b, n where support >= 3),
g as (select *, least(weighted / u, 1.0) as cal, support * n / (ca * cb) as lift, n / (n + 20) as shrink, support / u::double as p from e), h as (select *, greatest((p + 3.8416 / (2 * u) - 1.96::double * sqrt((p * (1 - p) + 3.8416::double / (4 * u)) / u)) / (1 + 3.8416::double / u), 0.0) as w from g where lift >= 1),
i as (select *, least(w, cal) * shrink as lower, cal * shrink as evidence from h)"""


@query(f"""{TEMPORAL}
select a, b, support, {A6("p")} as jaccard, {A6("cal")} as calibrated, {A6("lift")} as lift, {A6("support / ca::double")} as confidence_ab, {A6("support / cb::double")} as confidence_ba, {A6("evidence")} as evidence, {A6("lower")} as lower,
 case when support >= 5 and lower >= 0.10 and evidence >= 0.10 then 'supported' when support >= 2 and lower >= 0.01 and evidence >= 0.02 then 'limited' else 'low_support' end as class, split_part(a, '/', 1) <> split_part(b, '/', 1) as crosses from i""")
def temporal_coupling(spark, sf_dir):
    touches, commits, edges = coupled(spark, sf_dir)
    n = commits.count()
    return coupling.temporal_edges(coupling.neighbours(edges, CFG), coupling.coordination(touches, commits, CFG), n, CFG)


SPREAD = f"""{FACTS}, dg as (select src as path, count(*) as degree, count(*) filter (split_part(src, '/', 1) <> split_part(dst, '/', 1)) as outside from kept group by 1), sp as (select path, n_commits, change_diffusion, coalesce(degree, 0) as degree, coalesce(degree, 0) / 99.0::double as cen,
 coalesce(outside / nullif(degree, 0)::double, 0.0) * (n_commits / (n_commits + 5)::double) as cr from facts left join dg using (path))"""


@query(f"{SPREAD} select path, degree, {A6('cen')} as centrality, {A6('cr')} as cross, {A6('least(0.5::double * change_diffusion + 0.3::double * cen + 0.2::double * cr, 1.0)')} as coordination, {A6('least(0.45::double * cen + 0.35::double * cr + 0.20::double * change_diffusion, 1.0)')} as blast_radius from sp")
def blast_radius(spark, sf_dir):
    touches, commits, edges = coupled(spark, sf_dir)
    return coupling.spread(coupling.neighbours(edges, CFG), coupling.coordination(touches, commits, CFG), 100)


@query(f"{METRICS}, s as (select m.*, coalesce(age_days, 0) as age_days from metrics m left join aged using (path)), t as (select *, revisions / (revisions + 5)::double as hs, least(age_days / 90.0::double, 1.0) as ag from s) select path, case when n_authors > 0 then {A6('least(0.40::double * (top_author_share * hs * ag) + 0.35::double * least(least(author_entropy / 4, 1.0) * 0.6::double + least(n_authors / 10.0::double, 1.0) * 0.4::double, 1.0) + 0.25::double * (least(coalesce(days_since_human, 0) / 365.0::double, 1.0) * hs), 1.0)')} else 0.0 end as stewardship from t")
def stewardship(spark, sf_dir):
    rows = metrics(spark, sf_dir).join(ops.first_seen(fx.touches(spark, sf_dir), NOW).select("path", "age_days"), "path", "left").fillna({"age_days": 0})
    return overlays.stewardship(rows)


_RANKS = ["r0 as (select path, 1.0::double / (select count(*) from pn) as rank from pn)"]
for _i in range(20):
    _RANKS.append(f"r{_i + 1} as materialized (select p.path, 0.15::double / (select count(*) from pn) + 0.85::double * coalesce(sum(r.rank * w.w), 0.0) as rank from pn p left join pw w on w.dst = p.path left join r{_i} r on r.path = w.src group by 1)")


@query(f"{FACTS}, pn as (select distinct src as path from kept), pw as (select src, dst, support / sum(support) over (partition by src)::double as w from kept), {', '.join(_RANKS)} select path, {A6('rank')} as rank from r20")
def pagerank(spark, sf_dir):
    return coupling.pagerank(coupling.neighbours(edges(spark, sf_dir), CFG))


EDGES = f"""{TEMPORAL}, rel as (select a, b, 'temporal' as kind, weighted as score from i)"""


def related(spark, sf_dir) -> DataFrame:
    """All temporal edges with their weighted support; the pairs of commits are made once."""
    touches, commits, edges = coupled(spark, sf_dir)
    edges = stage(edges, "edges")
    whole = coupling.temporal_edges(coupling.neighbours(edges, CFG), coupling.coordination(touches, commits, CFG), commits.count(), CFG).select("a", "b")
    return edges.join(whole, ["a", "b"]).select("a", "b", F.lit("temporal").alias("kind"), F.col("weighted").alias("score"))


@query(f"{COMMITS} select commit_id, kind, weight from commits")
def calibration(spark, sf_dir):
    return ops.commits(fx.touches(spark, sf_dir)).select("commit_id", "kind", "weight")


_SCORED_REST = SCORED[len(BASE) :]


@query(f"""{EDGES}{_SCORED_REST}, top as (select * from scored order by score desc, tokens desc, path limit 10), en as (select unnest([a, b]) as path from rel), ne as (select path, count(*) as n from en group by 1)
select path, score, tokens, (select array_to_string(list(name order by v desc, i) [1:3], ',') from (values (age_pressure, 0, 'age_pressure'), (churn_pressure, 1, 'churn_pressure'), (revision_norm, 2, 'revision_norm'), (churn_norm, 3, 'churn_norm')) t(v, i, name) where v > 0) as pressures, coalesce(n, 0) as n_edges from top left join ne using (path)""")
def explain_top(spark, sf_dir):
    from gneiss.operators import lookup

    return lookup.explain_top(scored(spark, sf_dir), related(spark, sf_dir), 10, ["age_pressure", "churn_pressure", "revision_norm", "churn_norm"])


@query(f"{EDGES}, f as (select min(path) as p from tracked) select a, b, kind, score, 1 as hits from rel, f where a = p or b = p")
def show_path(spark, sf_dir):
    from gneiss.operators import lookup

    anchor = fx.tracked(spark, sf_dir).agg(F.min("path")).first()[0]
    return lookup.touching(related(spark, sf_dir), anchor)


@query(f"""{EDGES}{_SCORED_REST}, f as (select min(path) as p from tracked), ow as (select path, 0 as rank, 0.0::double as w from scored, f where path = p), nr as (select case when a = p then b else a end as path, 1 as rank, max(score) as w from rel, f where a = p or b = p group by 1),
bs as (select path, 2 as rank, score as w from scored, f where regexp_extract(path, '^(.*)/[^/]*$', 1) = regexp_extract(p, '^(.*)/[^/]*$', 1) and path <> p), al as (select *, row_number() over (partition by path order by rank, w desc) as k from (select * from ow union all select * from nr union all select * from bs))
select path, rank from al where k = 1 order by rank, w desc, path limit 5""")
def plan_anchor_scope(spark, sf_dir):
    from gneiss.operators import lookup

    anchor = fx.tracked(spark, sf_dir).agg(F.min("path")).first()[0]
    return lookup.anchor_scope(scored(spark, sf_dir), related(spark, sf_dir), anchor)


@query(f"{BASE} select count(*) as n_files, {NOW} - max(ts) > 86400 as stale, max(ts) - {NOW} > 300 as from_the_future from touches, (select count(*) as c from files)")
def freshness(spark, sf_dir):
    return fx.touches(spark, sf_dir).agg(F.count("*").alias("n_files"), (F.lit(NOW) - F.max("ts") > 86_400).alias("stale"), (F.max("ts") - NOW > 300).alias("from_the_future"))
