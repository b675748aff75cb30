"""Queries over two snapshots of the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gneiss.operators import compare
from gneiss.operators.inventory import context_band
from gneiss.operators.scoring import score_band
from gneiss.plans.ordering import global_rank
from gneiss.queries.facts import BAND
from gneiss.queries.registry import BASE, CFG, query
from gneiss.sources import fixtures as fx

A6 = lambda x: f"(sign({x}) * floor(abs({x}) * 1e6 + 0.5) / 1e6)"
SBAND = "case when score >= 85 then 'critical' when score >= 65 then 'high' when score >= 50 then 'moderate' else 'low' end"
SNAP = f"""{BASE}, b0 as (select path, text, tokens from files where doc_id % 10 <> 3), h0 as (select case when doc_id % 17 = 0 then 'moved/' || path else path end as path, case when doc_id % 13 = 0 then text || ' more and more words here' else text end as text, tokens + case when doc_id % 13 = 0 then 200 else 0 end as tokens from files where doc_id % 10 <> 7),
base as (select *, {BAND} as context_band, {SBAND} as score_band from (select path, sha256(text) as content, tokens, (tokens % 1000) / 10.0::double as score from b0)), head as (select *, {BAND} as context_band, {SBAND} as score_band from (select path, sha256(text) as content, tokens, (tokens % 1000) / 10.0::double as score from h0)),
gone as (select content, min(path) as old from base where path not in (select path from head) group by 1 having count(*) = 1), came as (select content, min(path) as new from head where path not in (select path from base) group by 1 having count(*) = 1), ren as (select old, new from gone join came using (content)),
bb as (select coalesce(new, path) as path, old as renamed_from, content, tokens, score, context_band, score_band from base left join ren on old = path),
d0 as (select path, renamed_from, b.content as bc, h.content as hc, b.tokens as base_tokens, h.tokens as head_tokens, b.score as bs, h.score as hs, b.context_band as bb, h.context_band as head_context_band, b.score_band as sb, h.score_band as head_score_band from bb b full join head h using (path)),
delta as (select path, renamed_from, case when bc is null then 'added' when hc is null then 'removed' when bc <> hc or renamed_from is not null then 'source_changed' when base_tokens <> head_tokens or bs <> hs then 'evidence_drift' else 'unchanged' end as status, bc is distinct from hc as content_changed, base_tokens, head_tokens,
 coalesce(head_tokens, 0) - coalesce(base_tokens, 0) as tokens_delta, {A6("(coalesce(hs, 0.0) - coalesce(bs, 0.0))")} as score_delta,
 case head_context_band when 'watch' then 1 when 'warning' then 2 when 'critical' then 3 else 0 end - case bb when 'watch' then 1 when 'warning' then 2 when 'critical' then 3 else 0 end as context_delta,
 case head_score_band when 'moderate' then 1 when 'high' then 2 when 'critical' then 3 else 0 end - case sb when 'moderate' then 1 when 'high' then 2 when 'critical' then 3 else 0 end as score_band_delta, head_context_band, head_score_band from d0)"""


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = fx.files(spark, sf_dir)
    more = F.col("doc_id") % 13 == 0
    head = files.filter("doc_id % 10 <> 7").select(
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(more, F.concat("text", F.lit(" more and more words here"))).otherwise(F.col("text")).alias("text"),
        (F.col("tokens") + F.when(more, 200).otherwise(0)).alias("tokens"),
    )
    return tuple(facts(df) for df in (files.filter("doc_id % 10 <> 3"), head))


def facts(df: DataFrame) -> DataFrame:
    rows = df.select("path", F.sha2("text", 256).alias("content"), "tokens", ((F.col("tokens") % 1000) / 10.0).alias("score"))
    return rows.withColumns({"context_band": context_band(F.col("tokens"), CFG.bands), "score_band": score_band(F.col("score"))})


def all_deltas(spark, sf_dir) -> DataFrame:
    return compare.deltas(*snapshots(spark, sf_dir))


@query(f"{SNAP} select * from ren")
def renames(spark, sf_dir):
    return compare.renames(*snapshots(spark, sf_dir))


@query(f"{SNAP} select * from delta")
def compare_deltas(spark, sf_dir):
    return all_deltas(spark, sf_dir)


@query(f"{SNAP} select status, count(*) as n, sum(tokens_delta)::bigint as tokens_delta, count(*) filter (score_delta > 0) as worsened, count(*) filter (score_delta < 0) as improved from delta group by 1")
def delta_counts(spark, sf_dir):
    return compare.delta_counts(all_deltas(spark, sf_dir))


@query(f"""{SNAP}, r as (select *, case when status = 'added' and (head_context_band in ('warning', 'critical') or head_score_band in ('high', 'critical')) then 'new_finding' when status = 'source_changed' and content_changed and (context_delta > 0 or score_band_delta > 0) then 'worse_band' when status = 'source_changed' and content_changed and score_delta >= 5 then 'material_score_increase' end as reason from delta)
select path, reason, case when head_context_band = 'critical' or head_score_band = 'critical' then 'error' when head_context_band = 'warning' or head_score_band = 'high' then 'warning' else 'notice' end as severity, score_delta, head_context_band, head_score_band from r where reason is not null""")
def regressions(spark, sf_dir):
    return compare.regressions(all_deltas(spark, sf_dir), CFG)


@query(f"""{SNAP}, l as (select coalesce(b.path, h.path) as path, unnest(['tokens', 'score']) as label, unnest([coalesce(h.tokens, 0)::double - coalesce(b.tokens, 0), coalesce(h.score, 0.0) - coalesce(b.score, 0.0)]) as v from base b full join head h on b.path = h.path) select path, label, {A6("v")} as delta from l where {A6("v")} <> 0""")
def overlay_deltas(spark, sf_dir):
    return compare.overlay_deltas(*snapshots(spark, sf_dir), ["tokens", "score"])


@query(f"""{SNAP}, bq as (select path, row_number() over (order by score desc, tokens desc, path) as p from base where score >= 50), hq as (select path, row_number() over (order by score desc, tokens desc, path) as p from head where score >= 50)
select path, b.p as base_position, h.p as head_position, h.p - b.p as moved, case when b.p is null then 'entered' when h.p is null then 'left' when h.p < b.p then 'up' when h.p > b.p then 'down' else 'same' end as movement from bq b full join hq h using (path)""")
def queue_movement(spark, sf_dir):
    order = [F.desc("score"), F.desc("tokens"), F.asc("path")]
    base, head = (global_rank(df.filter("score >= 50"), order) for df in snapshots(spark, sf_dir))
    return compare.queue_movement(base, head)


@query(f"{SNAP}, o as (select path, status, score_delta, row_number() over (order by score_delta desc, path) as position from delta where score_delta > 0) select * from o where position > 10 and position <= 30")
def compare_page(spark, sf_dir):
    rows = all_deltas(spark, sf_dir).filter("score_delta > 0").select("path", "status", "score_delta")
    return compare.page(rows, 10, 20, F.desc("score_delta"), F.asc("path"))


@query(f"{SNAP}, o as (select path, status, score_delta, row_number() over (order by score_delta desc, path) as position, count(*) over () as total from delta where score_delta > 0) select *, 20 as page_limit, total > 30 as has_more from o where position > 10 and position <= 30")
def compare_page_totals(spark, sf_dir):
    rows = all_deltas(spark, sf_dir).filter("score_delta > 0").select("path", "status", "score_delta")
    found, told = compare.page_with_totals(rows, 10, 20, F.desc("score_delta"), F.asc("path"))
    return found.withColumns({"total": F.lit(told["total"]).cast("long"), "page_limit": F.lit(told["limit"]), "has_more": F.lit(told["has_more"])})
