"""Positions in measures and the time signatures that follow from them.

Every window is partitioned by score, part and (for positions) measure, so one
task holds one part's measures at most; no operator sorts a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.rational import reduced, same_ratio


def ticks(duration: str | Column) -> Column:
    """A duration as a whole number; missing, blank and unreadable ones (grace notes) advance by nothing."""
    c = F.col(duration) if isinstance(duration, str) else duration
    return F.coalesce(F.trim(c.cast("string")).try_cast("long"), F.lit(0))


def measure_span(
    events: DataFrame, keys: list[str], order: list[str], kind: str = "kind", duration: str = "duration", chord: str = "has_chord"
) -> DataFrame:
    """``keys span n_bad``: the furthest position that each measure's notes reach.

    Notes (except further notes of a chord) and forwards advance, backups go back
    to the measure's start at most. With S the running sum of steps, the clamped
    position is ``S - least(0, running minimum of S)``; durations aren't negative.
    ``n_bad`` counts durations that are neither blank nor numbers.
    """
    d = ticks(duration)
    advances = (F.col(kind) == "forward") | ((F.col(kind) == "note") & ~F.coalesce(F.col(chord), F.lit(False)))
    step = F.when(F.col(kind) == "backup", -d).when(advances, d).otherwise(F.lit(0))
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = F.trim(F.col(duration).cast("string"))
    bad = (raw != "") & raw.try_cast("long").isNull()
    return (
        events.select(*keys, *order, step.alias("_step"), bad.alias("_bad"))
        .withColumn("_sum", F.sum("_step").over(running))
        .withColumn("_at", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(running)))
        .groupBy(*keys)
        .agg(F.greatest(F.lit(0), F.max("_at")).alias("span"), F.count_if("_bad").alias("n_bad"))
    )


def effective_signatures(
    measures: DataFrame, part: list[str], order: list[str],
    span: str = "span", divisions: str = "divisions", beats: str = "beats", beat_type: str = "beat_type",
) -> DataFrame:
    """``measures`` with ``sig_beats sig_beat_type``, the signature in force in each measure.

    A hint (``beats`` over ``beat_type``) takes effect where it stands; a filled
    measure whose length differs from the signature's takes the simplest fraction
    of its own length, and later measures keep that. Divisions stay until the
    next ones, 1 at first. Null until a hint or a filled measure.
    """
    by_part = Window.partitionBy(*part).orderBy(*order)
    so_far = by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    span_, div = F.col(span).cast("long"), F.coalesce(F.last(divisions, ignorenulls=True).over(so_far), F.lit(1)).cast("long")
    filled = F.coalesce(span_, F.lit(0)) > 0
    b, t = F.col(beats).cast("long"), F.col(beat_type).cast("long")
    ratio = lambda n, d: F.struct(n.alias("n"), d.alias("d"))
    stated = measures.withColumn("_div", div).withColumns(
        {
            "_own": F.when(filled, ratio(span_, F.col("_div"))),
            "_hint": F.when(b.isNotNull() & (t > 0), ratio(b * 4, t)),
        }
    )
    stated = stated.withColumn("_past", F.last(F.coalesce("_own", "_hint"), ignorenulls=True).over(before))
    own, hint, past = F.col("_own"), F.col("_hint"), F.col("_past")
    same = lambda x: same_ratio(x["n"], x["d"], own["n"], own["d"])
    low = reduced(own["n"], own["d"])
    simplest = F.struct(low["num"].alias("beats"), (low["den"] * 4).alias("beat_type"))
    hinted = F.struct(b.alias("beats"), t.alias("beat_type"))
    new = (
        F.when(own.isNull(), F.when(hint.isNotNull(), hinted))
        .when(hint.isNotNull(), F.when(same(hint), hinted).otherwise(simplest))
        .when(past.isNull() | ~same(past), simplest)
    )
    found = stated.withColumn("_new", new).withColumn("_sig", F.last("_new", ignorenulls=True).over(so_far))
    return found.select(
        *(f"`{c}`" for c in measures.columns), F.col("_sig.beats").alias("sig_beats"), F.col("_sig.beat_type").alias("sig_beat_type")
    )


def changes(measures: DataFrame, part: list[str], order: list[str], columns: tuple[str, ...] = ("sig_beats", "sig_beat_type")) -> DataFrame:
    """The rows whose value is there and differs from the one before in its part."""
    before = Window.partitionBy(*part).orderBy(*order)
    now, last = F.struct(*columns), F.struct(*(F.lag(c).over(before).alias(c) for c in columns))
    return measures.withColumn("_new", ~now.eqNullSafe(last)).where(F.col("_new") & F.col(columns[0]).isNotNull()).drop("_new")


def by_position(
    measures: DataFrame, leading: DataFrame, score: list[str], part: list[str], order: list[str],
    columns: tuple[str, ...] = ("sig_beats", "sig_beat_type"),
) -> DataFrame:
    """Every part's measures with the leading part's values at the same ordinal; beyond its end, its last ones.

    ``leading`` has one row per measure of each score's leading part.
    """
    place = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    lead = leading.select(*score, place(score).alias("_at"), F.struct(*columns).alias("_value"))
    last = lead.groupBy(*score).agg(F.max_by("_value", "_at").alias("_last"))
    found = (
        measures.withColumn("_at", place([*score, *part]))
        .join(lead, [*score, "_at"], "left")
        .join(last, score, "left")
        .withColumn("_value", F.when(F.col("_value").isNull(), F.col("_last")).otherwise(F.col("_value")))
    )
    return found.select(*(f"`{c}`" for c in measures.columns), *(F.col(f"_value.{c}").alias(c) for c in columns))
