"""Slices of parts by the measure ranges of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slice_measures(
    systems: DataFrame, measures: DataFrame, keys: list[str], number: str, order: list[str], first: str = "first", last: str = "last"
) -> DataFrame:
    """Each system's expected measures with what the part has under that number.

    The range is exploded and joined by equality. Of several measures with one
    number the last counts. Numbers that the part lacks stay, with ``found`` false.
    """
    expected = systems.where(F.col(first) <= F.col(last)).withColumn(number, F.explode(F.sequence(first, last)))
    rest = [c for c in measures.columns if c not in [*keys, number]]
    latest = measures.groupBy(*keys, number).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_m"), F.count(F.lit(1)).alias("n_same")
    )
    found = expected.join(latest, [*keys, number], "left")
    return found.select(
        *expected.columns, F.col("_m").isNotNull().alias("found"), F.coalesce("n_same", F.lit(0)).alias("n_same"), *(F.col(f"_m.{c}").alias(c) for c in rest)
    )


def aligned(sliced: DataFrame, keys: list[str], part: str, number: str, lead: DataFrame) -> DataFrame:
    """The slices of all parts at the numbers found in the leading part, ``lost`` where another part lacks one."""
    wanted = lead.where("found").select(*keys, number).distinct()
    return sliced.join(wanted, [*keys, number], "left_semi").withColumn("lost", ~F.col("found"))


def contiguity(measures: DataFrame, system: list[str], number: str) -> DataFrame:
    """``system first last n contiguous``: whether a system's numbers are all there, once each."""
    return (
        measures.groupBy(*system)
        .agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(number).alias("n"), F.count_distinct(number).alias("_d"))
        .select(
            *system, "first", "last", "n",
            ((F.col("n") == F.col("_d")) & (F.col("last") - F.col("first") + 1 == F.col("n"))).alias("contiguous"),
        )
    )


def gaps(systems: DataFrame, score: list[str], first: str = "first", last: str = "last", system: str = "system_id") -> DataFrame:
    """The systems, in order of their first measure, that don't start right after the one before."""
    by_score = Window.partitionBy(*score).orderBy(first, last, system)
    seen = systems.withColumns({"prev_last": F.lag(last).over(by_score), "prev_system": F.lag(system).over(by_score)})
    return seen.where(F.col("prev_last").isNotNull() & (F.col(first) != F.col("prev_last") + 1))
