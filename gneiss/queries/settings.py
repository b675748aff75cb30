"""Queries over layered settings and memory budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import budget, settings as ops
from gneiss.queries.registry import BASE, query
from gneiss.sources import fixtures as fx

ROOM, COMMITS = (64 << 20) + 3_000_000, 1000


@query(f"""{BASE}, r as (select path, bytes, row_number() over (order by path) as k, sum(bytes) over (order by path) as s from files), f as (select *, 3 * s + s // 2 + k * 10240 + {COMMITS * 384} + 67108864 as memory from r)
select path, bytes, (select max(k) from f where memory <= {ROOM}) as n_paths, (select max(memory) from f where memory <= {ROOM})::bigint as memory from f where memory <= {ROOM}""")
def memory_prefix(spark, sf_dir):
    rows, told = budget.fitting_prefix(fx.files(spark, sf_dir).select("path", "bytes"), ROOM, COMMITS)
    return rows.withColumns({"n_paths": F.lit(told["n_paths"]).cast("long"), "memory": F.lit(told["memory"]).cast("long")})


LAYERS = """select o_custkey as owner, o_orderkey as layer, case o_orderkey % 11
  when 0 then '{"history": {"max_commits": ' || o_orderkey % 900 || ', "follow_renames": true}, "bands": {"watch": ' || o_orderkey % 50 || '}}'
  when 1 then '{"bands": {"watch": "no number", "deep": {"a": {"b": ' || o_orderkey % 7 || '}}}}' when 2 then '{"bands": 5}' when 3 then '{"bands": {}, "list": [1, {"x": ' || o_orderkey % 5 || '}]}' when 4 then 'no json'
  when 5 then '{"list": {"a/b~c": false, "e": {}}, "history": {"max_commits": -4}}' when 6 then '[1, 2]' when 7 then '{"history": {"max_commits": {"odd": 1}}, "bands": {"deep": {"a": 3}}}' when 8 then '{}' when 9 then '{"list": {"e": {"f": "x"}}, "name": "n' || o_orderkey % 30 || '"}'
  else '{"bands": {"deep": {"a": {"c": 1}}, "watch": ' || o_orderkey % 60 || '}}' end as config from {orders}"""
MERGED = f"""with recursive layers as ({LAYERS.replace("{orders}", "orders")}), good as (select owner, layer, config::json as v from layers where json_valid(config) and json_type(config) = 'OBJECT'),
n as (select owner, layer, '' as pointer, v, true as obj from good union all select owner, layer, pointer || '/' || replace(replace(k, '~', '~0'), '/', '~1'), v -> ('$."' || k || '"'), json_type(v -> ('$."' || k || '"')) = 'OBJECT' from (select owner, layer, pointer, v, unnest(json_keys(v)) as k from n where obj)),
d as (select * from n where pointer <> ''), leaf as (select *, not obj as scalar from d where not obj or len(json_keys(v)) = 0),
stays as (select l.* from leaf l where not exists (select 1 from d x where x.owner = l.owner and x.layer > l.layer and not x.obj and (x.pointer = l.pointer or starts_with(l.pointer, x.pointer || '/'))) and not (l.scalar and exists (select 1 from d x where x.owner = l.owner and x.layer > l.layer and x.obj and x.pointer = l.pointer))),
m as (select * from stays l where l.scalar or (not exists (select 1 from d x where x.owner = l.owner and x.obj and x.pointer = l.pointer and x.layer > l.layer) and not exists (select 1 from d x where x.owner = l.owner and starts_with(x.pointer, l.pointer || '/') and not exists (select 1 from d y where y.owner = x.owner and not y.obj and y.pointer = l.pointer and y.layer > x.layer))))"""


def layers(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("setting_orders")
    return spark.sql(LAYERS.replace("{orders}", "setting_orders"))


@query(f"{MERGED} select owner, pointer, layer, replace(v::varchar, ' ', '') as value from m")
def merged_settings(spark, sf_dir):
    rows = ops.merged(layers(spark, sf_dir))
    return rows.select("owner", "pointer", "layer", F.replace(F.to_json("value"), F.lit(" "), F.lit("")).alias("value"))


WANTED = {"max_commits": ("/history/max_commits", "long", 10_000), "follow": ("/history/follow_renames", "boolean", False), "watch": ("/bands/watch", "double", 8000.0), "name": ("/name", "string", "none"), "b": ("/bands/deep/a/b", "long", -1)}


@query(f"""{MERGED}, t as (select owner, max(case when pointer = '/history/max_commits' and json_type(v) = 'UBIGINT' then v::bigint end) as mc, bool_or(case when pointer = '/history/follow_renames' and json_type(v) = 'BOOLEAN' then v::boolean end) as fr,
  max(case when pointer = '/bands/watch' and json_type(v) = 'UBIGINT' then v::double end) as w, max(case when pointer = '/name' then v ->> '$' end) as nm, max(case when pointer = '/bands/deep/a/b' and json_type(v) = 'UBIGINT' then v::bigint end) as b from m group by 1)
select o.owner, coalesce(mc, 10000) as max_commits, coalesce(fr, false) as follow, coalesce(w, 8000.0)::double as watch, coalesce(nm, 'none') as name, coalesce(b, -1) as b from (select distinct owner from layers) o left join t using (owner)""")
def typed_settings(spark, sf_dir):
    rows = layers(spark, sf_dir)
    return ops.settings(ops.merged(rows), rows.select("owner").distinct(), WANTED)
