"""Queries over rolled-up and retained evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import evidence, folders
from gneiss.queries.history import FACTS, FOLDERS, SCORED, coupled, scored
from gneiss.queries.registry import BASE, CFG, query
from gneiss.queries.similar import TERMS, terms
from gneiss.sources import fixtures as fx

A6 = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"


@query(f"""{FOLDERS} select folder, {A6("avg(churn_pressure)")} as mean_churn_pressure, {A6("avg(age_pressure)")} as mean_age_pressure, bool_or(revisions >= 50) as any_busy, max(score) as max_score, arg_min(path, (-score, path)) as top_path from ex group by 1""")
def folder_overlays(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("busy", F.col("revisions") >= 50)
    return evidence.folder_overlays(rows, ["churn_pressure", "age_pressure"], ["busy"], ["score"])


@query(f"""{TERMS}, ex as (select distinct unnest(['.', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) as folder, term from terms), k as (select *, row_number() over (partition by folder order by term) as k from ex) select folder, string_agg(term, ',' order by term) as terms from k where k <= 20 group by 1""")
def folder_terms(spark, sf_dir):
    return evidence.folder_terms(terms(spark, sf_dir))


@query(f"{SCORED} select path, tokens, revisions from scored where tokens >= 512 and (revisions >= 10 or (revisions >= 5 and tokens % 2 >= 1)) and classification in ('source', 'tool')")
def structural_eligible(spark, sf_dir):
    return evidence.eligible(scored(spark, sf_dir).withColumn("n_edges", F.col("tokens") % 2)).select("path", "tokens", "revisions")


@query(f"{FACTS}, big as (select path from tracked where tokens > 800) select a, b, support, case when support >= 10 then 'supported' else 'low_support' end as class from edges where a in (select path from big) and b in (select path from big) and support >= 10")
def pruned_edges(spark, sf_dir):
    edges = coupled(spark, sf_dir)[2].select("a", "b", "support", F.when(F.col("support") >= 10, "supported").otherwise("low_support").alias("class"))
    return evidence.pruned(edges, fx.tracked(spark, sf_dir).filter("tokens > 800"))


CLUSTERS = "select doc_id % 200 as id, case doc_id % 3 when 0 then 'candidate_set' when 1 then 'duplicate_set' else 'edge_set' end as kind, max(case when doc_id % 4 = 0 then n_chars end) as score, max(case when doc_id % 5 <> 0 then lang end) as label from documents group by 1, 2"


@query(f"""with c as ({CLUSTERS}), r as (select *, row_number() over (partition by id order by kind like 'candidate%', kind) as k from c)
select id, arg_min(kind, k) as kind, arg_min(score, k) filter (score is not null) as score, arg_min(label, k) filter (label is not null) as label from r group by 1""")
def merged_clusters(spark, sf_dir):
    return evidence.merged_clusters(spark.sql(CLUSTERS.replace("documents", "{documents}"), documents=fx.table(spark, sf_dir, "documents")))


CHECKED = "case doc_id % 3 when 0 then 'src/part_' || doc_id % 50 || '.rs' when 1 then 'scripts/check_part_' || doc_id % 50 || '_' || doc_id || '.sh' else 'x/other' || doc_id end"


@query(f"""with p as (select distinct {CHECKED} as path from documents), f as (select path, lower(regexp_replace(regexp_replace(split_part(list_last(string_split(path, '/')), '.', 1), '^(test_)+', ''), '(_test)+$', '')) as stem from p), c as (select path as chk, lower(path) as low from p where path like 'scripts/%'),
k as (select stem, chk, row_number() over (partition by stem order by chk) as position from (select distinct stem from f) join c on contains(low, stem))
select path, chk as check_path, position from f join k using (stem) where position <= 5""")
def verification_near(spark, sf_dir):
    files = fx.table(spark, sf_dir, "documents").select(F.expr(CHECKED).alias("path")).distinct()
    return evidence.verification_near(files)


@query(f"{FOLDERS} select folder, case when direct_tokens > 128000 and n_direct > 17 then 'files and tokens' when direct_tokens > 128000 then 'tokens' when n_direct > 17 then 'files' end as trigger from fo")
def folder_triggers(spark, sf_dir):
    rows = folders.rollup(scored(spark, sf_dir), CFG)
    return rows.select("folder", evidence.folder_trigger(F.col("direct_tokens"), F.col("n_direct"), CFG).alias("trigger"))


@query(f"{BASE} select path, array_to_string(list_filter(string_split_regex(lower(translate(path, '/._-', '    ')), ' +'), lambda t: length(t) > 1), ' ') as tokens from files")
def path_tokens(spark, sf_dir):
    return fx.files(spark, sf_dir).select("path", F.array_join(evidence.path_tokens(F.col("path")), " ").alias("tokens"))


@query(f"{FACTS} select quantile_disc(change_diffusion, 0.95) as diffusion_p95, count(*) as n_paths from facts")
def diffusion_p95(spark, sf_dir):
    from gneiss.functions.numeric import nearest_rank
    from gneiss.operators import coupling

    touches, commits, _ = coupled(spark, sf_dir)
    return coupling.coordination(touches, commits, CFG).agg(nearest_rank("change_diffusion", 0.95).alias("diffusion_p95"), F.count("*").alias("n_paths"))
