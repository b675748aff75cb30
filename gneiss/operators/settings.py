"""Layers of configuration as VARIANT values: merged member by member, read by pointer with a type and a default.

layers: owner, layer (later ones win) and config (JSON text). Objects are merged;
any other value, arrays too, replaces what was there, and so does an object in
place of something else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gneiss.staging import drop, stage

#: Types a setting may have, with the variants that count as such; nothing else is converted.
TYPES = {"long": "^BIGINT$", "double": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "string": "^STRING$"}


def nodes(layers: DataFrame) -> DataFrame:
    """(owner, layer, pointer, kind, value): every member of every layer, kind object or leaf; a round for each level of nesting.

    Text that is no JSON object gives no rows; an empty object is a node without
    members. / and ~ in names are escaped as in JSON pointers.
    """
    spark = layers.sparkSession
    kind = F.when(F.schema_of_variant("v").startswith("OBJECT"), "object").otherwise("leaf")
    level = layers.select("owner", "layer", F.lit("").alias("pointer"), F.try_parse_json("config").alias("v")).filter("v is not null")
    level = stage(level.withColumn("kind", kind).filter("kind = 'object'"), "settings")
    out, levels = None, [level]
    while True:
        open_ = level.filter("kind = 'object'").select("owner", "layer", "pointer", "v")
        below = spark.sql("select owner, layer, pointer, x.key, x.value as v from {open} o, lateral variant_explode(o.v) x", open=open_)
        name = F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        level = stage(below.select("owner", "layer", F.concat("pointer", F.lit("/"), name).alias("pointer"), "v").withColumn("kind", kind), "settings")
        if level.isEmpty():
            drop(level)
            break
        levels.append(level)
        out = level if out is None else out.unionByName(level)
    return (levels[0].limit(0) if out is None else out).select("owner", "layer", "pointer", "kind", F.col("v").alias("value"))


def pointers_above(pointer: Column) -> Column:
    """A pointer and all it lies in, the outermost first."""
    parts = F.split(pointer, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def merged(layers: DataFrame) -> DataFrame:
    """(owner, pointer, layer, value): what is left of all layers, a row for each leaf and each object that stays empty.

    A leaf stays if no later layer sets it, or puts another value in place of
    anything it lies in. Each leaf meets the last replacement of each pointer
    above it; layers are never folded one after the other.
    """
    every = nodes(layers)
    last = every.groupBy("owner", "pointer").agg(F.max(F.when(F.col("kind") == "leaf", F.col("layer"))).alias("replaced"), F.max(F.when(F.col("kind") == "object", F.col("layer"))).alias("opened"))
    leaves = every.filter((F.col("kind") == "leaf") | (F.schema_of_variant("value") == "OBJECT<>"))
    keys = leaves.select("owner", "layer", "pointer", "kind", F.explode(pointers_above(F.col("pointer"))).alias("above"))
    met = keys.join(last.withColumnRenamed("pointer", "above"), ["owner", "above"])
    own = F.col("above") == F.col("pointer")
    gone = F.coalesce(F.col("replaced") > F.col("layer"), F.lit(False)) | (own & (F.col("kind") == "leaf") & F.coalesce(F.col("opened") > F.col("layer"), F.lit(False)))
    # an empty object says nothing where an object was before it, or a later one has members
    kept = met.groupBy("owner", "layer", "pointer", "kind").agg(F.bool_or(gone).alias("gone"), F.max(F.when(own, F.col("replaced"))).alias("replaced"), F.max(F.when(own, F.col("opened"))).alias("opened")).filter(~F.col("gone"))
    empty = kept.filter("kind = 'object' and opened = layer")
    filled = every.select("owner", F.regexp_extract("pointer", "^(.*)/[^/]*$", 1).alias("pointer"), F.col("layer").alias("by"))
    filled = filled.groupBy("owner", "pointer").agg(F.max("by").alias("by"))
    empty = empty.join(filled, ["owner", "pointer"], "left").filter(F.col("by").isNull() | (F.coalesce("replaced", F.lit(-1)) > F.col("by"))).select("owner", "layer", "pointer")
    chosen = kept.filter("kind = 'leaf'").select("owner", "layer", "pointer").unionByName(empty)
    return leaves.select("owner", "layer", "pointer", "value").join(chosen, ["owner", "layer", "pointer"]).select("owner", "pointer", "layer", "value")


def typed(value: Column, kind: str) -> Column:
    """A value as a type of TYPES, null where it is of another; longs are not negative."""
    found = F.when(F.schema_of_variant(value).rlike(TYPES[kind]), F.try_variant_get(value, "$", kind))
    return F.when(found >= 0, found) if kind == "long" else found


def settings(values: DataFrame, owners: DataFrame, wanted: dict[str, tuple[str, str, object]]) -> DataFrame:
    """A row for each owner with a column for each wanted name: (pointer, type, default), the default where nothing fits."""
    columns = [F.max(F.when(F.col("pointer") == pointer, typed(F.col("value"), kind))).alias(name) for name, (pointer, kind, _) in wanted.items()]
    found = values.filter(F.col("pointer").isin(*[p for p, _, _ in wanted.values()])).groupBy("owner").agg(*columns)
    rows = owners.select("owner").join(found, "owner", "left")
    return rows.select("owner", *[F.coalesce(F.col(n), F.lit(default).cast(kind)).alias(n) for n, (_, kind, default) in wanted.items()])


def unknown(values: DataFrame, pointers: list[str]) -> DataFrame:
    """Rows of merged values under pointers that are not known."""
    return values.filter(~F.col("pointer").isin(*pointers))
