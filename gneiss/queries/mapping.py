"""Queries that map sources to tests by all four rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions.text import COMMON
from gneiss.operators import overlays
from gneiss.queries.registry import query
from gneiss.queries.similar import TERMS, terms
from gneiss.sources import fixtures as fx
from gneiss.staging import stage

#: Of the documents' paths, some with a long part in their names, so that the second rule is reached.
NAMED = "case cast(regexp_extract(path, '_([0-9]+)[.]', 1) as int) % 7 when 0 then replace(path, '_', '_reader_') when 1 then replace(path, '_', '_x_writer') else path end"
MAPPINGS = (("*/en/doc_1*.rs", "*/de/test_*"), ("nothing/*", "*"), ("*.json", "no/test"))
WORDS = ", ".join(f"'{w}'" for w in sorted(COMMON))


@query(f"""{TERMS}, p as (select {NAMED} as path from files), kept as (select distinct {NAMED} as path, term from terms where term not in ({WORDS}) and strlen(term) > 2),
f as (select path, lower(regexp_replace(regexp_replace(split_part(list_last(string_split(path, '/')), '.', 1), '^(test_)+', ''), '(_test)+$', '')) as stem from p), t as (select path as test, lower(path) as low from p where list_last(string_split(path, '/')) like 'test\\_%' escape '\\'),
g as (select distinct stem, coalesce(list_filter(string_split(stem, '_'), lambda x: strlen(x) >= 5)[1], '') as prefix from f), s as (select stem, test, 1 as strength from g join t on contains(low, stem) where stem <> ''),
w as (select stem, test, 2 as strength from g join t on contains(low, prefix) where prefix <> '' and stem not in (select stem from s)),
two as (select a.path, b.path as test, 3 as strength from kept a join kept b using (term) where b.path in (select test from t) group by 1, 2 having count(*) >= 2),
a as (select path, test, strength from f join (select * from s union all select * from w) using (stem) union all select * from two union all select path, test, 0 from f, t where regexp_matches(path, '/en/doc_1[^/]*[.]rs$') and contains(test, '/de/test_')),
m as (select path, test, min(strength) as strength from a group by 1, 2), k as (select *, row_number() over (partition by path order by strength, test) as position from m)
select path, test, strength, position from k where position <= 5""")
def mapped_tests(spark, sf_dir):
    files = fx.files(spark, sf_dir).select(F.expr(NAMED).alias("path"))
    return overlays.test_mapping(files, terms=stage(terms(spark, sf_dir).withColumn("path", F.expr(NAMED)), "terms"), mappings=MAPPINGS)
