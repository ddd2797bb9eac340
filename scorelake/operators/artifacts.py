"""Artifacts and their checksums: what is out of date, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators import graph

# The stages in the order in which they run, with those that they read.
STAGES = {
    "original": [],
    "pages": ["original"],
    "omr": ["pages"],
    "musicxml": ["omr"],
    "musicxml_clean": ["musicxml"],
    "score_info": ["musicxml"],
    "lilypond": ["musicxml_clean", "score_info"],
    "ly_render": ["lilypond"],
    "layout": ["omr"],
    "images": ["pages", "layout"],
    "xml_snippets": ["musicxml_clean", "layout"],
    "ly_snippets": ["xml_snippets"],
}


def decisions(stages: DataFrame, recorded: DataFrame, dependencies: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys stage reason`` for every stage: why it must run, null if it needn't.

    ``stages``: keys, stage, has_dependencies. ``recorded``: keys, stage, outputs (array of
    paths), sources (map of path to checksum). ``dependencies``: keys, stage, path as
    they are now. ``artifacts``: keys, path, checksum of what exists. The first
    reason that holds counts: ``no_metadata no_outputs output_missing no_checksums
    dependencies_differ dependency_changed``. Outputs are looked up, not compared.
    """
    k = [*keys, "stage"]
    have = artifacts.select(*keys, "path", F.col("checksum").alias("_now"))
    outputs = recorded.select(*k, F.explode("outputs").alias("path")).join(have, [*keys, "path"], "left")
    outputs = outputs.groupBy(*k).agg(F.bool_or(F.col("_now").isNull()).alias("_lost"))
    then = recorded.select(*k, F.explode("sources").alias("path", "_then"))
    both = dependencies.select(*k, "path", F.lit(True).alias("_is")).join(then, [*k, "path"], "full_outer").join(have, [*keys, "path"], "left")
    sources = both.groupBy(*k).agg(
        F.bool_or(F.col("_is").isNull() | F.col("_then").isNull()).alias("_differ"),
        F.bool_or(~F.col("_now").eqNullSafe(F.col("_then"))).alias("_changed"),
    )
    known = recorded.select(*k, F.size(F.coalesce("outputs", F.array())).alias("_outputs"), F.size(F.coalesce("sources", F.create_map().cast("map<string,string>"))).alias("_sources"))
    rows = stages.join(known, k, "left").join(outputs, k, "left").join(sources, k, "left")
    reason = (
        F.when(F.col("_outputs").isNull(), "no_metadata")
        .when(F.col("_outputs") == 0, "no_outputs")
        .when(F.col("_lost"), "output_missing")
        .when(F.col("has_dependencies") & (F.col("_sources") == 0), "no_checksums")
        .when(F.col("_differ"), "dependencies_differ")
        .when(F.col("_changed"), "dependency_changed")
    )
    return rows.select(*k, reason.alias("reason"))


def downstream(stages: dict[str, list[str]] = STAGES) -> list[tuple[str, str]]:
    """Pairs of a stage and one that is affected by it, itself included."""
    out: dict[str, set] = {}
    for stage, deps in stages.items():
        out[stage] = {stage}.union(*(out[d] for d in deps))
    return [(up, stage) for stage, ups in out.items() for up in stages if up in ups]


def affected(stale: DataFrame, keys: list[str], stages: dict[str, list[str]] = STAGES) -> DataFrame:
    """``keys stage because`` for every stage that runs again if those of ``stale`` do; the earliest cause is told.

    The stage graph is a constant of the program, so it is broadcast.
    """
    order = {s: i for i, s in enumerate(stages)}
    pairs = stale.sparkSession.createDataFrame([(a, b, order[a]) for a, b in downstream(stages)], "cause string, stage string, at int")
    hit = stale.select(*keys, F.col("stage").alias("cause")).join(F.broadcast(pairs), "cause")
    return hit.groupBy(*keys, "stage").agg(F.min_by("cause", "at").alias("because"))


def invalidated(stale: DataFrame, dependencies: DataFrame, keys: list[str]) -> DataFrame:
    """``keys stage because distance in_cycle``: every stage that runs again if those of ``stale`` (keys, stage) do.

    Each bundle has its own graph: ``dependencies`` holds keys, stage, dep, of any depth. The nearest
    cause is told, of equally near ones the least. ``in_cycle``: the stage comes back to itself, so
    no order of its graph is one in which it could run.
    """
    edges = dependencies.select(*keys, F.col("dep").alias("up"), F.col("stage").alias("down"))
    found = graph.followed(edges, keys, stale.select(*keys, F.col("stage").alias("node")))
    return found.select(*keys, F.col("node").alias("stage"), "because", F.col("n").alias("distance"), "in_cycle")


def incomplete(recorded: DataFrame, dependencies: DataFrame, keys: list[str]) -> DataFrame:
    """The dependencies ``keys stage dep`` whose stage has no recorded outputs."""
    done = recorded.where(F.size("outputs") > 0).select(*keys, F.col("stage").alias("dep"))
    return dependencies.join(done, [*keys, "dep"], "left_anti")


def vector_documents(pages: DataFrame, document: list[str]) -> DataFrame:
    """``document is_vector``: whether any page lacks resources, objects or an image. Pages: ``has_resources n_objects n_images``."""
    bare = ~F.coalesce("has_resources", F.lit(False)) | (F.coalesce("n_objects", F.lit(0)) == 0) | (F.coalesce("n_images", F.lit(0)) == 0)
    return pages.groupBy(*document).agg(F.coalesce(F.bool_or(bare), F.lit(False)).alias("is_vector"))


def needs_preprocessing(kind: Column, is_vector: Column, noop: Column) -> Column:
    """Scans are prepared unless all settings are off; kind is ``vector``, ``scan`` or ``auto``."""
    return F.when(noop, False).when(kind == "vector", False).when(kind == "scan", True).otherwise(~is_vector)


def pages_between(pages: DataFrame, document: list[str], page: str, first: Column, last: Column) -> DataFrame:
    """The pages first to last of each document (1-based, inclusive) with ``in_range``: false where the document is shorter."""
    totals = pages.groupBy(*document).agg(F.max(page).alias("_pages"))
    return pages.where(F.col(page).between(first, last)).join(totals, document).withColumn("in_range", last <= F.col("_pages")).drop("_pages")


def succeeded(results: DataFrame, is_book: Column, ok: str = "ok", error: str = "error") -> DataFrame:
    """The results that hold. A failed page is left out; a failed book stops the job."""
    checked = F.when(is_book & ~F.col(ok), F.raise_error(F.concat(F.lit("book failed: "), F.coalesce(error, F.lit(""))))).otherwise(F.col(ok))
    return results.where(checked.cast("boolean"))
