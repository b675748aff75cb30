"""Queries over duplicate files, shared vocabulary and tests next to sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gneiss.functions import text as texts
from gneiss.operators import overlays, similarity
from gneiss.queries.facts import CLASS, STEM, STEM_S
from gneiss.queries.registry import BASE, CFG, query
from gneiss.sources import fixtures as fx

A6 = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9_'']+'), lambda t: length(t) > 1)"
CAND = f"""{BASE}, cand as (select path, text, len(tok) as n_tokens, tok from (select path, text, {TOKENS} as tok, {CLASS} as cls from files) where len(tok) between 100 and 50000 order by n_tokens desc, path limit 500)"""
SHINGLES = f"""{CAND}, sh as (select path, sha256(text) as fingerprint, list_distinct(case when n_tokens < 8 then tok else list_transform(range(0, n_tokens - 7, 32), lambda i: array_to_string(tok[i + 1:i + 8], chr(31))) end) as shingles from cand)"""
PAIRS = f"""{SHINGLES}, ix as (select path, len(shingles) as n, unnest(shingles) as s from sh), nr as (select a.path as a, b.path as b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::double as sim from ix a join ix b on a.s = b.s and a.path < b.path group by 1, 2),
ex as (select a.path as a, b.path as b from sh a join sh b on a.fingerprint = b.fingerprint and a.path < b.path),
dup as (select coalesce(n.a, e.a) as a, coalesce(n.b, e.b) as b, case when e.a is not null then 'exact' else 'near' end as kind, case when e.a is not null then 1.0 else {A6("sim")} end as score, case when e.a is not null then 'supported' else 'limited' end as class from (select * from nr where sim >= 0.72) n full join ex e on n.a = e.a and n.b = e.b)"""


def pairs(spark, sf_dir) -> DataFrame:
    return similarity.duplicate_pairs(similarity.shingled(similarity.candidates(fx.files(spark, sf_dir), CFG), CFG), CFG)


def terms(spark, sf_dir) -> DataFrame:
    return similarity.top_terms(fx.files(spark, sf_dir), CFG)


@query(f"{SHINGLES} select path, fingerprint, len(shingles)::bigint as n_shingles from sh")
def shingles(spark, sf_dir):
    rows = similarity.shingled(similarity.candidates(fx.files(spark, sf_dir), CFG), CFG)
    return rows.select("path", "fingerprint", F.size("shingles").cast("long").alias("n_shingles"))


@query(f"{PAIRS} select * from dup")
def near_duplicates(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(f"{BASE} select sha256(text) as fingerprint, count(*) as n_files, min(path) as first_path, max(path) as last_path from files group by 1 having count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return similarity.exact_groups(fx.files(spark, sf_dir))


@query(f"""{PAIRS.replace("with files", "with recursive files", 1)}, sym as (select a as u, b as v from dup union select b, a from dup), reach as (select u, v from sym union select r.u, s.v from reach r join sym s on r.v = s.u), comp as (select u as node, least(u, min(v)) as component from reach group by 1)
select component, count(*) as n_members, any_value(n_edges) as n_edges, least(any_value(n_edges) / 5.0::double, 1.0) as score from comp join (select c.component, count(*) as n_edges from dup d join comp c on c.node = d.a group by 1) e using (component) group by 1""")
def duplicate_clusters(spark, sf_dir):
    return similarity.clusters(pairs(spark, sf_dir))


UNHELPFUL = ", ".join(f"'{w}'" for w in texts.UNHELPFUL)
OF_ALL = f"""{BASE}, cand as (select path, {TOKENS} as tok from files)"""
TERMS = f"""{OF_ALL}, tk as (select path, unnest(tok) as t from cand), ws as (select distinct t from tk), s1 as (select t as w, {STEM_S} as u from ws), s2 as (select w, substring(u, 2) as t from s1 where u like '+%'), s3 as (select w, {STEM_S} as u from s2), s4 as (select w, substring(u, 2) as t from s3 where u like '+%'),
st as (select w, u as stem from s1 where u not like '+%' union all select w, u from s3 where u not like '+%' union all select w, {STEM.format(rest="t")} from s4),
tc as (select path, stem as term, count(*) as count from tk join st on st.w = tk.t where t not in ({UNHELPFUL}) and stem not in ({UNHELPFUL}) group by 1, 2 having count(*) >= 2), terms as (select *, row_number() over (partition by path order by count desc, term) as position from tc qualify position <= 25)"""


@query(f"{TERMS} select * from terms")
def top_terms(spark, sf_dir):
    return terms(spark, sf_dir)


@query(f"""{TERMS.replace(OF_ALL, CAND)}, np as (select count(distinct path) as n from terms), ra as (select path, term from terms where strlen(term) >= 4), cm as (select term from ra group by 1 having count(distinct path) <= (select greatest(n // 3, 2) from np)), rr as (select path, term from ra join cm using (term)), sz as (select path, count(*) as n from rr group by 1),
sd as (select a.path as a, b.path as b, count(*) as support from rr a join rr b on a.term = b.term and a.path < b.path and split_part(a.path, '/', 1) <> split_part(b.path, '/', 1) group by 1, 2), sm as (select a, b, support, support / (x.n + y.n - support)::double as similarity from sd join sz x on x.path = a join sz y on y.path = b),
em as (select distinct path from terms where path not in (select path from sz)), al as (select * from sm union all select x.path, y.path, 0, 1.0 from em x join em y on x.path < y.path and split_part(x.path, '/', 1) <> split_part(y.path, '/', 1))
select a, b, support, {A6("similarity")} as similarity, case when similarity >= 0.6 then 'limited' else 'low_support' end as class from al where similarity >= 0.35 order by al.similarity desc, a, b limit 100""")
def lexical_affinity(spark, sf_dir):
    return similarity.lexical_pairs(similarity.top_terms(similarity.candidates(fx.files(spark, sf_dir), CFG), CFG), CFG)


COMMON = ", ".join(f"'{w}'" for w in texts.COMMON)


@query(f"""{TERMS}, ts as (select term, count(distinct path) as df, count(distinct split_part(path, '/', 1)) as n_roots from terms group by 1), nf as (select count(*) as n from files),
w0 as (select t.path, t.term, df, ln((n + 1.0::double) / (df + 1)) + 1 as idf, n_roots > 1 and df <= greatest(n // 4, 2) as wanders from terms t join ts using (term), nf where t.term not in ({COMMON}) and strlen(t.term) > 2),
w1 as (select *, row_number() over (partition by path order by wanders desc, term) as k, row_number() over (partition by path order by df, term) as r from w0)
select path, count(*) filter (wanders and k <= 25) as n_drifting, {A6("least(coalesce(sum(idf) filter (wanders and k <= 25), 0.0) / sum(idf), 1.0)")} as dispersion, coalesce(string_agg(term, ',' order by r) filter (r <= 5), '') as distinctive from w1 group by 1""")
def dispersion(spark, sf_dir):
    return overlays.dispersion(terms(spark, sf_dir), fx.files(spark, sf_dir).count(), CFG)


@query(f"""{PAIRS}, en as (select unnest([a, b]) as path, a, b, kind, score from dup), rk as (select *, row_number() over (partition by path order by score desc, kind, a, b) as position, count(*) over (partition by path) as raw from en)
select path, a, b, kind, score, position, raw, greatest(raw - 3, 0) as suppressed from rk where position <= 3""")
def relationship_refs(spark, sf_dir):
    return similarity.ranked_relationships(pairs(spark, sf_dir), 3)


@query(f"{PAIRS} select a, b, kind, score from dup order by score desc, a, b limit 40")
def relationships_ranked(spark, sf_dir):
    return pairs(spark, sf_dir).orderBy(F.desc("score"), "a", "b").limit(40).select("a", "b", "kind", "score")


STEMMED = "case doc_id % 3 when 0 then 'src/parse_' || doc_id % 40 || '.rs' when 1 then 'tests/test_parse_' || doc_id % 40 || '_' || doc_id || '.rs' else 'lib/reader_' || doc_id % 70 || '_x.py' end"


@query(f"""with p as (select distinct {STEMMED} as path from documents), f as (select path, lower(regexp_replace(regexp_replace(split_part(list_last(string_split(path, '/')), '.', 1), '^(test_)+', ''), '(_test)+$', '')) as stem from p), t as (select path as test, lower(path) as low from p where path like 'tests/%'),
g as (select distinct stem, coalesce(list_filter(string_split(stem, '_'), lambda x: strlen(x) >= 5)[1], '') as prefix from f), s as (select stem, test, 1 as strength from g join t on contains(low, stem) where stem <> ''),
w as (select stem, test, 2 as strength from g join t on contains(low, prefix) where prefix <> '' and stem not in (select stem from s)), k as (select *, row_number() over (partition by stem order by strength, test) as position from (select * from s union all select * from w))
select path, test, strength, position from f join k using (stem) where position <= 5""")
def test_mapping(spark, sf_dir):
    files = fx.table(spark, sf_dir, "documents").select(F.expr(STEMMED).alias("path")).distinct()
    return overlays.test_mapping(files)


@query(f"""{BASE}, x as (select path, {CLASS} as classification, tokens % 100::double as score, doc_id % 7 = 0 as inline_tests, case doc_id % 4 when 0 then 1 when 1 then 2 end as strength, doc_id % 5 as degree, doc_id % 3 as test_neighbours from (select 'src/' || path as path, bytes, tokens, doc_id from files)),
y as (select *, classification = 'test' as test from x), z as (select *, case when test or inline_tests or coalesce(strength = 1, false) then 1.0 when strength is not null then 0.5 else 0.0 end as adjacency, coalesce(test_neighbours / nullif(degree, 0)::double, 0.0) as ratio, not test and not inline_tests and score >= 50 and strength is null as hotspot from y)
select path, adjacency::double as adjacency, {A6("ratio")} as test_ratio, hotspot, case when classification in ('source', 'tool') and not test then {A6("case when inline_tests then 0.0 else least((1 - adjacency::double) * 0.6::double + (1 - least(ratio, 1.0)) * 0.2::double + case when hotspot then 0.2::double else 0.0 end, 1.0) end")} end as gap from z""")
def verification_gap(spark, sf_dir):
    from gneiss.functions import paths

    rows = fx.files(spark, sf_dir).withColumn("path", F.concat(F.lit("src/"), "path"))
    facts = rows.select("path", paths.classification(F.col("path")).alias("classification"), (F.col("tokens") % 100).cast("double").alias("score"), (F.col("doc_id") % 7 == 0).alias("inline_tests"), F.expr("case doc_id % 4 when 0 then 1 when 1 then 2 end").alias("strength"), (F.col("doc_id") % 5).alias("degree"), (F.col("doc_id") % 3).alias("test_neighbours"))
    return overlays.verification_gap(facts)


