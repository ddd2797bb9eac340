"""Attributes that stay in force: carried values, and what a slice must repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_last(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``carried_<column>``: the last value that isn't null up to each row of its key."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({f"carried_{c}": F.last(c, ignorenulls=True).over(so_far) for c in columns})


def in_force(
    attributes: DataFrame, part: list[str], key: list[str], system: str, order: list[str], value: str, n_systems: str
) -> DataFrame:
    """``part system key value key_order``: what each system starts with, by part and key.

    ``attributes`` has one row per attribute with the ordinal (from 1) of the
    system that it stands in, its place in document order and the number of systems of
    its score. The last value of a key in one system holds at the start of the
    following ones up to and including the next that sets it, so each is exploded over
    just those: no range join. ``key_order`` orders a part's keys as first seen.
    Null key columns are values like others.
    """
    keys = [*part, *key]
    last = attributes.groupBy(*keys, system).agg(
        F.max_by(value, F.struct(*order)).alias(value), F.min(F.struct(*order)).alias("_first"), F.max(n_systems).alias("_n")
    )
    by_key = Window.partitionBy(*keys).orderBy(system)
    spans = last.withColumns(
        {
            "_until": F.least(F.coalesce(F.lead(system).over(by_key), F.col("_n")), F.col("_n")),
            "_seen": F.first("_first").over(by_key),
        }
    ).where(F.col("_until") > F.col(system))
    each = spans.select(
        *keys, value, "_seen", F.explode(F.sequence(F.col(system) + 1, F.col("_until"))).alias(system)
    )
    place = Window.partitionBy(*part, system).orderBy("_seen", *key)
    return each.select(*part, system, *key, value, F.row_number().over(place).alias("key_order"))


def missing(carried: DataFrame, present: DataFrame, place: list[str], key: list[str]) -> DataFrame:
    """The carried rows whose key the place doesn't have itself; nulls in keys are equal."""
    have = present.select(*place, *key).distinct().select(*(F.col(c).alias(f"_{c}") for c in [*place, *key]))
    same = [carried[c] == have[f"_{c}"] for c in place] + [carried[c].eqNullSafe(have[f"_{c}"]) for c in key]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return carried.join(have, on, "left_anti")


def inject(present: DataFrame, carried: DataFrame, place: list[str], key: list[str], order: str, tag: str = "tag") -> DataFrame:
    """The attributes of each place after the missing carried ones are put in.

    They go after ``divisions``, or to the front where there are none, in the order
    in which the keys were first seen (``key_order``). ``injected`` tells them.
    """
    added = missing(carried, present, place, key)
    common = [c for c in present.columns if c in added.columns and c != order]
    early = Window.partitionBy(*place)
    own = present.withColumn("_div", F.min(F.when(F.col(tag) == "divisions", F.col(order))).over(early))
    own = own.select(
        *common, F.when(F.col(order) <= F.col("_div"), 0).otherwise(2).alias("_band"), F.col(order).cast("long").alias("_at"), F.lit(False).alias("injected")
    )
    put = added.select(*common, F.lit(1).alias("_band"), F.col("key_order").cast("long").alias("_at"), F.lit(True).alias("injected"))
    at = Window.partitionBy(*place).orderBy("_band", "_at")
    return own.unionByName(put).withColumn(order, F.row_number().over(at)).drop("_band", "_at")
