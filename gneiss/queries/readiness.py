"""Queries over many runs' readiness, consistency and freshness, on runs made of customers and their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import readiness as ops
from gneiss.queries.registry import query
from gneiss.sources import fixtures as fx

RUNS = """select c_custkey as run, case c_custkey % 5 when 0 then 'partial' when 1 then null else 'complete' end as analysis_status, c_custkey % 3 as omitted, case when c_custkey % 2 = 0 then 'compact' else 'full' end as profile,
  case c_custkey % 4 when 0 then true when 1 then false end as worktree_clean, c_custkey % 7 <> 0 as has_compare_index, c_custkey % 11 > 3 as has_policy_index from {customer}"""
COLLECTIONS = """select c_custkey as run, collection, cast(c_custkey % 9 as bigint) as total, cast(case when c_custkey % 8 = 0 then 1 when c_custkey % 13 <> 0 then c_custkey % 9 end as bigint) as returned, c_custkey % 10 = 3 as truncated
  from {customer} cross join (select 'files' as collection union all select 'folders' union all select 'compare_index/files' union all select 'compare_index/folders' union all select 'policy_index/files') k where not (c_custkey % 6 = 0 and collection like '%folders')"""
ENTRY = "case when o_orderkey % 29 = 0 then null else 'f' || o_orderkey % 40 end"
PUBLIC = f"""select distinct o_custkey as run, {ENTRY} as path, 'c' || o_orderkey % 40 as content, case when o_orderkey % 3 = 0 then 'x' end as fingerprint, case o_orderkey % 8 when 0 then 'skipped' when 1 then 'odd' else 'analyzed' end as status,
  case when o_orderkey % 8 = 0 then case o_orderkey % 16 when 0 then 'binary' else 'too_large' end end as reason from {{orders}}"""
INDEX = "select run, path, case when run % 5 = 0 and path like '%7' then 'other' else content end as content, case when run % 3 <> 0 then fingerprint end as fingerprint, status, case when run % 4 = 1 then null else reason end as reason from ({public}) p where run % 10 <> 9"
EVIDENCE = "select distinct o_custkey as run, o_orderpriority as field, case when o_custkey % 4 = 0 then 'incomplete_history' when o_custkey % 4 = 1 then 'complete' end as status from {orders}"
NAMES = {"customer": "customer", "orders": "orders"}
DUCK = f"with runs as ({RUNS.format(**NAMES)}), collections as ({COLLECTIONS.format(**NAMES)}), public as ({PUBLIC.format(**NAMES)}), ix as ({INDEX.format(public='select * from public')}), evidence as ({EVIDENCE.format(**NAMES)})"
DUCK += """, told as (select distinct run, path, (content, fingerprint, status, reason) as t from ix where path is not null), one as (select run, path, list(t order by t.content nulls first, t.fingerprint nulls first, t.status nulls first, t.reason nulls first) as ts from (select run, path, {'content': content, 'fingerprint': fingerprint, 'status': status, 'reason': reason} as t from ix where path is not null group by all) group by 1, 2),
rec as (select p.run, p.path, ts is null or not list_contains(ts, {'content': p.content, 'fingerprint': p.fingerprint, 'status': p.status, 'reason': p.reason}) as odd, ts is null as unknown from public p left join one o on o.run = p.run and o.path = p.path),
inc as (select run, count(*) filter (not coalesce(status = 'analyzed' or (status = 'skipped' and coalesce(reason in ('binary', 'gitlink', 'undecodable'), false)), false)) as n from ix group by 1), pinc as (select run, count(*) filter (not coalesce(status = 'analyzed' or (status = 'skipped' and coalesce(reason in ('binary', 'gitlink', 'undecodable'), false)), false)) as n from public group by 1),
gaps as (select r.run, has_compare_index, coalesce(case when has_compare_index then i.n else q.n end, 0) as n_incomplete, coalesce(o.n, 0) as n_inconsistent from runs r left join inc i using (run) left join pinc q using (run) left join (select run, count(*) filter (odd) as n from rec group by 1) o using (run)),
w as (select run, case when has_compare_index then 'compare_index/' else '' end || c as collection, 'canonical_collection_incomplete' as code from runs, (values ('files'), ('folders')) v(c) union all select run, 'policy_index/' || c, 'policy_index_incomplete' from runs, (values ('files'), ('folders')) v(c) where has_policy_index),
wc as (select w.run, case when c.collection is null then 'collection_metadata_missing' when truncated or total is null or returned is null or total <> returned then code end as code, '/collection_metadata/' || w.collection as pointer from w left join collections c on c.run = w.run and c.collection = w.collection),
found as (select run, 'analysis_incomplete' as code, '/diagnostics/analysis/analysis_status' as pointer, 1 as n from runs where coalesce(analysis_status, '') <> 'complete' union all select run, 'inventory_paths_omitted', '/diagnostics/analysis/degraded_omitted_path_count', 1 from runs where omitted > 0
  union all select run, 'comparison_index_missing', '/compare_index/files', 1 from runs where profile = 'compact' and not has_compare_index union all select run, 'policy_index_missing', '/policy_index/files', 1 from runs where profile = 'compact' and not has_policy_index
  union all select run, 'dirty_worktree_baseline', '/repo/worktree_clean', 1 from runs where worktree_clean = false union all select run, code, pointer, 1 from wc where code is not null
  union all select run, 'inventory_evidence_incomplete', case when has_compare_index then '/compare_index/files' else '/files' end, n_incomplete from gaps where n_incomplete + n_inconsistent > 0 union all select run, 'comparison_index_inconsistent', '/compare_index/files', n_inconsistent from gaps where n_inconsistent > 0
  union all select e.run, 'evidence_incomplete', '/evidence_completeness/' || field, 1 from evidence e where status like 'incomplete\\_%' escape '\\' and run in (select run from runs))"""


def tables(spark, sf_dir) -> tuple:
    base = {t: fx.table(spark, sf_dir, t) for t in ("customer", "orders")}
    public = spark.sql(PUBLIC.format(orders="{orders}"), orders=base["orders"])
    index = spark.sql(INDEX.format(public="select * from {public}"), public=public)
    return tuple(spark.sql(sql, **{k: v for k, v in base.items() if "{" + k + "}" in sql}) for sql in (RUNS, COLLECTIONS)) + (public, index, spark.sql(EVIDENCE, orders=base["orders"]))


@query(f"{DUCK} select run, path, unknown, odd from rec")
def reconciled_records(spark, sf_dir):
    _, _, public, index, _ = tables(spark, sf_dir)
    rows = ops.reconciled(public, index)
    return rows.select("run", "path", F.col("path").isNull().__or__(F.array_contains("mismatches", "not_indexed")).alias("unknown"), (F.size("mismatches") > 0).alias("odd"))


@query(f"{DUCK} select run, code, pointer, n from found")
def readiness_blockers(spark, sf_dir):
    return ops.blockers(*tables(spark, sf_dir), clean_worktree=True)


@query(f"""{DUCK} select r.run, coalesce(analysis_status = 'complete', false) as analysis_complete, n_incomplete + n_inconsistent = 0 as inventory_complete, r.run not in (select run from found where code = 'evidence_incomplete') as evidence_complete,
  c is null as comparison_ready, coalesce(c, '') as codes from runs r join gaps using (run) left join (select run, string_agg(code, ',' order by code) as c from found group by 1) f on f.run = r.run""")
def run_readiness(spark, sf_dir):
    rows = ops.readiness(*tables(spark, sf_dir), clean_worktree=True)
    return rows.withColumn("codes", F.array_join("codes", ","))


STATES = """select {k} as {id}, {k} % 30 as repo, case when {k} % 7 = {d} then null else 'h' || {k} % 30 end as head, 'w' || {k} % {m} as worktree_digest, case when {k} % 9 = {d} then 'v1' else 'v2' end as version, case when {k} % 5 = {d} then null else 'c' || {k} % {m} end as config_digest,
  'p' || {k} % {m} as path_digest, {k} % 3 = 0 as degraded, case {k} % 6 when 0 then null when 1 then cast(990000000 as bigint) when 2 then cast(996711000 as bigint) else cast(996700000 as bigint) end as generated_at from {customer}"""


@query(f"""with r as ({STATES.format(k="c_custkey", id="run", d=0, m=15, customer="customer")}), n as (select * from ({STATES.format(k="c_custkey", id="id", d=1, m=10, customer="customer")}) where id < 28),
t as (select r.run, {fx.NOW} - r.generated_at as age_seconds, [case when r.head is distinct from n.head then 'head_changed' end, case when r.worktree_digest is distinct from n.worktree_digest then 'worktree_changed' end, case when r.version is distinct from n.version then 'analyzer_changed' end,
  case when n.config_digest is null then 'config_unavailable' when r.config_digest is distinct from n.config_digest then 'config_changed' end, case when not r.degraded and r.path_digest is distinct from n.path_digest then 'scope_changed' end,
  case when r.generated_at is null then 'report_age_unknown' when {fx.NOW} - r.generated_at > 86400 then 'report_too_old' when {fx.NOW} - r.generated_at < -300 then 'report_from_future' end] as x from r left join n on n.repo = r.repo)
select run, len(list_filter(x, lambda y: y is not null)) = 0 as current, age_seconds, array_to_string(list_filter(x, lambda y: y is not null), ',') as reasons from t""")
def run_freshness(spark, sf_dir):
    customers = fx.table(spark, sf_dir, "customer")
    state = lambda **kw: spark.sql(STATES.format(k="c_custkey", customer="{customer}", **kw), customer=customers)
    rows = ops.freshness(state(id="run", d=0, m=15), state(id="id", d=1, m=10).filter("id < 28"), fx.NOW)
    return rows.withColumn("reasons", F.array_join("reasons", ","))
