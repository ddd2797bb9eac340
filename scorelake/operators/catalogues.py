"""Catalogues of any shape: JSON documents as VARIANT columns that are changed by paths.

Nothing but what a change names is touched, so keys that no schema knows stay as they are.
A change holds for one path: it sets a value, or takes the key away. Documents are opened
level by level along the paths that are changed, their entries joined to the changes, and
put together again; there are as many rounds as the longest path has keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGES = "path array<string>, value variant"


def read(rows: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """``keys catalogue``: the documents as VARIANT; null where a text is no JSON or no object."""
    v = F.try_parse_json(F.col(json))
    return rows.select(*keys, F.when(F.substring(F.trim(F.col(json)), 1, 1) == "{", v).alias("catalogue"))


def write(catalogues: DataFrame, keys: list[str]) -> DataFrame:
    """``keys json``: as text, the keys of each object in their order by code points."""
    return catalogues.select(*keys, F.to_json("catalogue").alias("json"))


def _quoted(key: Column) -> Column:
    """A JSON string of a key, by way of an array of one."""
    told = F.to_json(F.array(key))
    return F.substring(told, F.lit(2), F.length(told) - 2)


def changed(catalogues: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys catalogue`` after ``changes`` (keys, path, value): a null value takes the key away.

    What lies on a path and is no object becomes one. Of changes of one
    document no path may begin with or be another's. Documents without changes, null ones with
    changes too, stay; changes of documents that aren't there do nothing.
    """
    deepest = changes.agg(F.max(F.size("path"))).first()[0] or 0
    return _changed(catalogues.select(*keys, "catalogue"), changes.select(*keys, "path", "value"), keys, deepest)


def _changed(documents: DataFrame, changes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    if depth <= 0:
        return documents
    wanted = changes.select(*keys).distinct()
    # names of a document's own keys are kept apart from those of its entries
    own = f"_key_{len(keys)}"
    opened = documents.join(wanted, keys, "left_semi").where("catalogue IS NOT NULL")
    entries = opened.lateralJoin(opened.sparkSession.tvf.variant_explode(F.col("catalogue").outer())).select(*keys, F.col("key").alias(own), F.col("value").alias("catalogue")).where(F.col(own).isNotNull())
    named = changes.join(opened.select(*keys), keys, "left_semi").withColumn(own, F.get("path", F.lit(0)))
    ends = named.where("size(path) = 1").select(*keys, own, F.col("value").alias("_new"), F.lit(True).alias("_is"))
    inner = named.where("size(path) > 1").select(*keys, own, F.slice("path", F.lit(2), F.size("path")).alias("path"), "value")
    whole = entries
    if depth > 1:
        at = [*keys, own]
        asked = inner.select(*at).distinct().withColumn("_asked", F.lit(True))
        both = entries.join(asked, at, "full_outer")
        empty = F.parse_json(F.lit("{}"))
        is_object = F.schema_of_variant("catalogue").startswith("OBJECT")
        below = both.where("_asked").select(*at, F.when(F.coalesce(is_object, F.lit(False)), F.col("catalogue")).otherwise(empty).alias("catalogue"))
        whole = both.where("_asked IS NULL").select(*at, "catalogue").unionByName(_changed(below, inner, at, depth - 1))
    merged = whole.join(ends, [*keys, own], "full_outer").select(*keys, own, F.when(F.col("_is"), F.col("_new")).otherwise(F.col("catalogue")).alias("_v")).where("_v IS NOT NULL")
    text = F.concat(_quoted(F.col(own)), F.lit(":"), F.to_json("_v"))
    parts = merged.groupBy(*keys).agg(F.array_join(F.collect_list(text), ",").alias("_parts"))
    made = opened.select(*keys).join(parts, keys, "left").select(*keys, F.parse_json(F.concat(F.lit("{"), F.coalesce("_parts", F.lit("")), F.lit("}"))).alias("_made"))
    return documents.join(made, keys, "left").select(*keys, F.coalesce("_made", "catalogue").alias("catalogue"))
