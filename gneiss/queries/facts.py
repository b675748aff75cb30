"""Queries over file facts: paths, text, bands, rollups of one inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gneiss.functions import paths, text as texts
from gneiss.functions.numeric import half_away
from gneiss.operators import health, inventory, overlays, policy
from gneiss.plans.ordering import global_rank
from gneiss.queries.registry import BASE, CFG, query
from gneiss.sources import fixtures as fx

BAND = "case when tokens <= 256 then 'healthy' when tokens <= 640 then 'watch' when tokens <= 800 then 'warning' else 'critical' end"
EXT = "list_last(string_split(lower(path), '.'))"
LANG = f"case {EXT} when 'md' then 'Markdown' when 'rs' then 'Rust' when 'py' then 'Python' when 'json' then 'JSON' when 'go' then 'Go' else 'Plain Text' end"
NAME = "list_last(string_split(lower(path), '/'))"
CLASS = f"""case when {NAME} like 'test\\_%' escape '\\' or {NAME} like '%\\_test.%' escape '\\' then 'test'
  when lower(path) like '%.md' then 'docs' when lower(path) like 'src/%' then 'source' else 'other' end"""
PROFILE = f"case when {EXT} = 'json' and bytes >= 262144 then 'data_context' else 'agent_context' end"
LINES = "case when text = '' then []::varchar[] else string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) end"


def files(spark, sf_dir) -> DataFrame:
    return inventory.inventory(fx.files(spark, sf_dir), CFG)


@query(f"{BASE} select path, bytes, tokens, {LANG} as language, {CLASS} as classification, {PROFILE} as profile, {BAND} as context_band, least(tokens / 800.0::double, 1.0) as context_pressure from files")
def files_inventory(spark, sf_dir):
    return files(spark, sf_dir).select("path", "bytes", "tokens", "language", "classification", "profile", "context_band", "context_pressure")


@query(f"""{BASE} select b.context_band, b.band_rank, count(f.path) as n_files, coalesce(sum(f.tokens), 0)::bigint as tokens
from (values ('healthy', 0), ('watch', 1), ('warning', 2), ('critical', 3)) b(context_band, band_rank) left join (select path, tokens, {BAND} as band from files) f on f.band = b.context_band group by 1, 2""")
def band_counts(spark, sf_dir):
    return inventory.band_counts(files(spark, sf_dir))


@query(f"{BASE} select root, sum(tokens)::bigint as tokens, sum(tokens) / (select sum(tokens) from files)::double as share, max(tokens) / sum(tokens)::double as largest_share from files group by 1")
def token_share_by_root(spark, sf_dir):
    return inventory.share_by_root(files(spark, sf_dir))


@query(f"""{BASE}, r as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder from files),
k as (select folder, path, tokens, row_number() over (partition by folder order by tokens desc, path) as position, sum(tokens) over (partition by folder) as folder_tokens from r)
select folder, path, position, tokens, tokens / folder_tokens::double as share from k where position <= 3""")
def share_of_folder(spark, sf_dir):
    return inventory.rank_in_folder(files(spark, sf_dir))


@query(f"{BASE} select path, {LANG} as language from files union all select path, {LANG} from tracked")
def language_of(spark, sf_dir):
    both = fx.files(spark, sf_dir).select("path").unionByName(fx.tracked(spark, sf_dir).select("path"))
    return both.select("path", paths.language(F.col("path")).alias("language"))


@query(f"{BASE} select path, {CLASS} as classification from (select path from files union all select path from tracked)")
def classify_path(spark, sf_dir):
    both = fx.files(spark, sf_dir).select("path").unionByName(fx.tracked(spark, sf_dir).select("path"))
    return both.select("path", paths.classification(F.col("path")).alias("classification"))


@query(f"{BASE} select path, case when {EXT} = 'json' and bytes >= 3000 then 'data_context' else 'agent_context' end as profile from files")
def profile_of(spark, sf_dir):
    return fx.files(spark, sf_dir).select("path", paths.profile(F.col("path"), F.col("bytes"), 3000).alias("profile"))


@query(f"{BASE} select path, case {EXT} when 'md' then 'markdown' when 'txt' then 'prose' else 'code' end as mode from files")
def structural_mode(spark, sf_dir):
    return fx.files(spark, sf_dir).select("path", paths.structural_mode(F.col("path")).alias("mode"))


@query(f"""{BASE} select path, {NAME} like 'test\\_%' escape '\\' or {NAME} like '%\\_test.%' escape '\\' as is_test, false as is_verification from (select path from files union all select path from tracked)""")
def test_path(spark, sf_dir):
    both = fx.files(spark, sf_dir).select("path").unionByName(fx.tracked(spark, sf_dir).select("path"))
    return both.select("path", paths.is_test(F.col("path")).alias("is_test"), paths.is_verification(F.col("path")).alias("is_verification"))


VERIFY = "case doc_id % 3 when 0 then '.github/workflows/w' || doc_id || '.yml' when 1 then 'scripts/' || case doc_id % 2 when 0 then 'check_' else 'build_' end || doc_id || '.sh' else 'x/scripts/verify' || doc_id end"


@query(f"select {VERIFY} as path, doc_id % 3 <> 1 or doc_id % 2 = 0 as is_verification from documents")
def verification_path(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select(F.expr(VERIFY).alias("path"))
    return rows.select("path", paths.is_verification(F.col("path")).alias("is_verification"))


@query(f"""{BASE}, l as (select path, {LANG} as language, text, unnest({LINES}) as line from files),
m as (select path, language, trim(line, ' ' || chr(9) || chr(13)) as bare from l),
c as (select path, count(*) as total, count(*) filter (bare <> '' and not starts) as code, count(*) filter (bare <> '' and starts) as comment, count(*) filter (bare = '') as blank
from (select *, case when language in ('Python') then bare like '#%' when language = 'Markdown' then bare like '<!--%' else bare like '//%' end or bare like '/*%' as starts from m) group by path)
select path, coalesce(total, 0) as total, coalesce(code, 0) as code, coalesce(comment, 0) as comment, coalesce(blank, 0) as blank from files left join c using (path)""")
def line_counts(spark, sf_dir):
    return inventory.text_facts(fx.files(spark, sf_dir)).select("path", "total", "code", "comment", "blank")


FENCED = "replace(coalesce(text, ''), '. ', case doc_id % 2 when 0 then '.' || chr(10) || '```' || chr(10) else '.' || chr(10) end)"


@query(f"""with f as (select doc_id, {FENCED} as text from documents), l as (select doc_id, generate_subscripts({LINES}, 1) as i, unnest({LINES}) as line from f),
g as (select *, ltrim(line) like '```%' as fence, sum((ltrim(line) like '```%')::int) over (partition by doc_id order by i) % 2 = 1 as inside from l),
c as (select doc_id, count(*) filter (not fence and not inside) as prose, count(*) filter (not fence and inside) as fenced from g group by 1)
select doc_id, coalesce(prose, 0) as prose, coalesce(fenced, 0) as fenced from f left join c using (doc_id)""")
def structural_categories(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.expr(FENCED.replace("chr(10)", "'\\n'")).alias("text"))
    return rows.select("doc_id", texts.text_lines(F.col("text"), F.lit("Markdown")).alias("f")).select("doc_id", "f.prose", "f.fenced")


MARKED = "case doc_id % 6 when 0 then '#[test]' when 1 then 'func TestX' when 2 then 'def test_y' when 3 then 'it(' when 4 then '@Test' else '' end || ' ' || coalesce(text, '')"
MARK_LANG = "case doc_id % 5 when 0 then 'Rust' when 1 then 'Go' when 2 then 'Python' when 3 then 'TSX' else 'Swift' end"


def _marked() -> str:
    """SQL of the marks of each language, over the whole text."""
    rungs = [f"when {MARK_LANG} = '{name}' then {' or '.join(f'contains(m, {chr(39)}{mark}{chr(39)})' for mark in marks)}" for names, marks in texts.INLINE_TESTS.items() for name in names]
    return f"case {' '.join(rungs)} else false end"


@query(f"select doc_id, {_marked()} as inline_tests from (select doc_id, {MARKED} as m from documents)")
def inline_tests(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED).alias("text"), F.expr(MARK_LANG).alias("language"))
    return rows.select("doc_id", texts.inline_tests(F.col("text"), F.col("language")).alias("inline_tests"))


@query(f"{BASE} select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, split_part(path, '/', 1) as root, len(string_split(path, '/')) as depth from files")
def path_parts(spark, sf_dir):
    path = F.col("path")
    return fx.files(spark, sf_dir).select("path", paths.parent(path).alias("folder"), paths.root(path).alias("root"), F.size(F.split(path, "/")).cast("long").alias("depth"))


@query(f"{BASE}, a as (select path, unnest(['.', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) as folder from files) select * from a")
def ancestors(spark, sf_dir):
    return fx.files(spark, sf_dir).select("path", F.explode(paths.ancestors(F.col("path"))).alias("folder"))


@query(f"{BASE} select path from files where path = 'src1/en' or path like 'src1/en/%'")
def scope_filter(spark, sf_dir):
    return fx.files(spark, sf_dir).filter(paths.in_scope(F.col("path"), "./src1//en/")).select("path")


@query(f"{BASE} select path from files where not ({NAME} like 'test%' or {NAME} like '%.json' or path like 'src2/%' or regexp_matches(path, '^src3/(.*/)?doc_[0-9][13579]\\.'))")
def ignore_globs(spark, sf_dir):
    return fx.files(spark, sf_dir).filter(~paths.ignored(F.col("path"), ("test*", "*.{json,lock}", "src2/**", "src3/**/doc_?[13579].*"))).select("path")


@query(f"""{BASE} select path, case when path like 'src1/%' then {CLASS} when {NAME} like '%.rs' then 'generated' else {CLASS} end as classification,
case when path like 'src1/%' then 'data_context' else {PROFILE} end as profile from files""")
def path_overrides(spark, sf_dir):
    rows = inventory.apply_overrides(files(spark, sf_dir), [("**/*.rs", "generated", None), ("src1/**", None, "data_context")])
    return rows.select("path", "classification", "profile")


@query(f"""{BASE}, t as (select path, tokens from files)
select count(*) as n_files, sum(tokens)::bigint as tokens, quantile_cont(tokens, 0.5) as p50, quantile_cont(tokens, 0.9) as p90, quantile_cont(tokens, 0.95) as p95, quantile_cont(tokens, 0.99) as p99, max(tokens) as largest,
floor((select sum(tokens) from (select tokens from t order by tokens desc limit 1)) / sum(tokens)::double * 1e6 + 0.5) / 1e6 as top_1_share,
floor((select sum(tokens) from (select tokens from t order by tokens desc limit 5)) / sum(tokens)::double * 1e6 + 0.5) / 1e6 as top_5_share,
floor((select sum(tokens) from (select tokens from t order by tokens desc limit 10)) / sum(tokens)::double * 1e6 + 0.5) / 1e6 as top_10_share from t""")
def health_distribution(spark, sf_dir):
    return health.distribution(files(spark, sf_dir))


@query(f"{BASE} select {PROFILE} as profile, count(*) as n_files, sum(tokens)::bigint as tokens, sum(bytes)::bigint as bytes from files group by 1")
def profile_rollup(spark, sf_dir):
    return health.by_profile(files(spark, sf_dir))


@query(f"""{BASE}, g as (select {PROFILE} as profile, {LANG} as language, count(*) as n_files, sum(tokens)::bigint as tokens from files group by 1, 2)
select *, floor(tokens / sum(tokens) over (partition by profile)::double * 1e6 + 0.5) / 1e6 as share from g""")
def language_rollup(spark, sf_dir):
    return health.by_language(files(spark, sf_dir))


@query(f"{BASE} select path, tokens, {CLASS} as classification, 256 - tokens as headroom from files where tokens <= 256 and tokens >= 192")
def watchlist(spark, sf_dir):
    return health.watchlist(files(spark, sf_dir), CFG)


@query(f"""{BASE}, r as (select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, {NAME} as name, len(string_split(path, '/')) as depth from files),
c as (select *, count(*) over (partition by list_last(string_split(path, '/'))) as same_name, count(*) over (partition by folder) as siblings from r), a as (select *, least((same_name - 1) / 5.0::double, 1.0) as amb from c)
select path, depth, siblings, same_name, floor(amb * 1e6 + 0.5) / 1e6 as ambiguity,
floor(least((depth - 1) / 8.0::double * 0.35::double + (siblings - 1) / 30.0::double * 0.35::double + amb * 0.30::double, 1.0) * 1e6 + 0.5) / 1e6 as navigation from a""")
def navigation(spark, sf_dir):
    rows = overlays.navigation(fx.files(spark, sf_dir))
    return rows.withColumn("depth", F.col("depth").cast("long"))


@query(f"""{BASE}, n as (select count(*) as n_paths, sum(bytes)::bigint as n_bytes from files),
w as (select *, greatest(6, ceil(n_bytes / 4194304.0) + ceil(n_paths / 2000.0) + 3)::bigint as warm_s, (floor(n_bytes * 3.5) + n_paths * 10240 + 15000 * 384 + 67108864)::bigint as memory from n)
select n_paths, n_bytes, warm_s, greatest(10, 2 * warm_s)::bigint as cold_s, memory, floor(memory * 0.75)::bigint as memory_low, floor(memory * 1.75)::bigint as memory_high from w""")
def estimate(spark, sf_dir):
    return inventory.estimate(fx.files(spark, sf_dir), 15_000)


@query(f"""{BASE}, r as (select path, root, row_number() over (partition by root order by path) as turn from files) select path, root, turn from r order by turn, root limit 77""")
def balanced_sample(spark, sf_dir):
    return policy.balanced_sample(fx.files(spark, sf_dir), paths.root(F.col("path")), 77)


@query(f"""{BASE}, a as (select path, row_number() over (order by tokens desc, path) as position from files), b as (select path, row_number() over (order by path) as position from files where tokens <= 256),
u as (select path, 0 as list_no, position from a where position <= 30 union all select path, 1, position from b), f as (select path, min((list_no, position)) as place from u group by 1)
select path, place[1] as list_no, place[2] as position from f order by list_no, position, path limit 60""")
def compact_selection(spark, sf_dir):
    from pyspark.sql import Window

    rows = files(spark, sf_dir)
    first = rows.orderBy(F.desc("tokens"), "path").limit(30).withColumn("position", F.row_number().over(Window.orderBy(F.desc("tokens"), "path")))
    small = global_rank(rows.filter("context_band = 'healthy'"), [F.asc("path")])
    return policy.prioritized([first, small], 60)


@query(f"""{BASE} select count(*) as n_files, 0::bigint as without_tokens, count(*) filter (tokens = 0) as empty, count(*) filter ({CLASS} = 'other') as unclassified, count(path) - count(distinct path) as repeated_paths from files""")
def readiness(spark, sf_dir):
    return policy.readiness(files(spark, sf_dir))


@query("""select o_custkey as case_id, count(*) as n, case max(case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 when '3-MEDIUM' then 1 else 0 end) when 3 then 'reject' when 2 then 'revise' when 1 then 'abstain' else 'approve' end as verdict from orders group by 1""")
def verdicts(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.expr("case o_orderpriority when '1-URGENT' then 'reject' when '2-HIGH' then 'revise' when '3-MEDIUM' then 'abstain' else 'approve' end").alias("verdict"))
    return policy.aggregate_verdicts(rows)


@query("""with r as (select p_partkey as id, p_partkey * 7 % 250 as x, p_partkey * 3 % 300 as y from part), p as (select id, unnest([x, y]) as other from r)
select distinct least('r' || id, 'r' || other) as a, greatest('r' || id, 'r' || other) as b from p where other in (select id from r) and id <> other""")
def policy_conflicts(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").selectExpr("concat('r', p_partkey) as rule_id", "array(concat('r', p_partkey * 7 % 250), concat('r', p_partkey * 3 % 300)) as conflicts_with")
    return policy.conflicts(rows)


@query("select 'c' || l_partkey as citation, l_orderkey as case_id, l_linenumber::bigint as line from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)")
def citations_invalid(spark, sf_dir):
    cited = fx.table(spark, sf_dir, "lineitem").selectExpr("concat('c', l_partkey) as citation", "l_orderkey as case_id", "cast(l_linenumber as bigint) as line")
    return policy.invalid_citations(cited, fx.table(spark, sf_dir, "part").filter("p_size > 5").selectExpr("concat('c', p_partkey) as citation"))


@query("""with r as (select s_suppkey as run_id, s_suppkey * 37 % 101 as created, 100 + s_suppkey % 13 * 10 as bytes from supplier), w as (select *, row_number() over o as position, sum(bytes) over (o rows between unbounded preceding and current row)::bigint as running from r window o as (order by created desc, run_id desc))
select run_id, created, bytes, position, running, max((position > 1 and (position > 20 or running > 2500))::int) over (order by position rows between unbounded preceding and current row) = 0 as kept from w""")
def retention_plan(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as run_id", "s_suppkey * 37 % 101 as created", "100 + s_suppkey % 13 * 10 as bytes")
    return policy.retention(rows, 20, 2500)


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_'']+')) as token from documents), c as (select doc_id, count(*) filter (length(token) > 1) as n_tokens from t group by 1) select d.doc_id, coalesce(n_tokens, 0) as n_tokens, regexp_replace(regexp_replace(text, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') as split from documents d left join c using (doc_id)""")
def term_split(spark, sf_dir):
    text = F.col("text")
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.size(texts.ascii_tokens(text)).cast("long").alias("n_tokens"), texts.split_case(text).alias("split"))


STEM = """case when t like '%ies' and length(t) >= 6 then left(t, -3) || 'y'
 when t like '%ing' and length(t) >= 7 then case when t[-4] = t[-5] then left(t, -4) else left(t, -3) end
 when t like '%ed' and length(t) >= 6 then case when t[-3] = t[-4] then left(t, -3) else left(t, -2) end else {rest} end"""
STEM_S = STEM.format(rest="case when not regexp_matches(t, '(ss|us|is)$') and t like '%s' and length(t) >= 5 then '+' || left(t, -1) else t end")


@query(f"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t from documents), s as (select t as term, {STEM_S} as u from w),
p as (select term, substring(u, 2) as t from s where u like '+%'), q as (select term, {STEM_S} as u from p), r as (select term, substring(u, 2) as t from q where u like '+%')
select term, u as stem from s where u not like '+%' union all select term, u from q where u not like '+%' union all select term, {STEM.format(rest="t")} from r""")
def stems(spark, sf_dir):
    words = fx.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("term")).distinct()
    return words.select("term", texts.stem(F.col("term")).alias("stem"))


@query(f"""{BASE}, v as (select path, unnest([{{'o': 'pressure', 'v': least(tokens / 800.0::double, 1.0)}}, {{'o': 'one', 'v': 1.0::double}}, {{'o': 'flat', 'v': 0.5::double + (tokens % 2) / 1000.0::double}}]) as x from files),
b as (select x.o as overlay, least(floor(x.v * 10), 9) as bin, count(*) as c, count(*) filter (x.v >= 0.999) as f, min(x.v) as lo, max(x.v) as hi from v group by 1, 2), n as (select overlay, sum(c) as n from b group by 1),
s as (select overlay, n, sum(f) as f, max(hi) - min(lo) as r, -sum(c / n * log2(c / n)) as bits from b join n using (overlay) group by 1, 2)
select overlay, n::bigint as n, case when n < 10 then 'kept' when f >= 0.9 * n then 'saturated' when r < 0.01 then 'flat' when bits < 0.2 then 'low_entropy' else 'kept' end as verdict from s""")
def overlay_suppression(spark, sf_dir):
    rows = files(spark, sf_dir).select(F.col("context_pressure").alias("pressure"), F.lit(1.0).alias("one"), (F.lit(0.5) + (F.col("tokens") % 2) / 1000.0).alias("flat"))
    return overlays.saturated(rows, ["pressure", "one", "flat"])


@query(None)
def bpe_tokens(spark, sf_dir):
    from gneiss.functions.udfs import bpe_count

    return fx.files(spark, sf_dir).select("path", bpe_count()(F.col("text")).alias("bpe_tokens"))


@query(None)
def unicode_words(spark, sf_dir):
    from gneiss.functions.udfs import content_token_count

    return fx.files(spark, sf_dir).select("path", content_token_count(F.col("text")).alias("n_words"))


@query(None)
def stable_ids(spark, sf_dir):
    from gneiss.functions.udfs import stable_id

    return fx.files(spark, sf_dir).select("path", stable_id(F.lit("file"), F.array("path", "root")).alias("id"))
