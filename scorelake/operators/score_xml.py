"""Score documents as node tables: events, measures, cleaning, snippets.

Nodes come from :func:`scorelake.sources.xml_nodes.xml_nodes`. New elements take
the place ``(node_id, sub)``: the node after which they stand, and their order there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.text import doctype
from scorelake.operators import carry, slicing, timing
from scorelake.sources.tables import materialize
from scorelake.sources.xml_nodes import child_text, parent, serialize, without_subtrees, xml_nodes

# What a cleaned score leaves out.
TOP_LEVEL = ["work", "identification", "defaults", "credit", "movement-number", "movement-title"]
OF_SCORE_PART = ["score-instrument", "midi-instrument", "midi-device"]
COORDINATES = ["default-x", "default-y", "relative-x", "relative-y"]
STYLES = ["font-family", "font-size", "font-weight", "font-style", "color", "halign", "valign"]
BY_TAG = {
    "measure": ["width"],
    "sound": ["dynamics"],
    "slur": ["bezier-x", "bezier-y", "bezier-x2", "bezier-y2", "placement"],
    "staff-details": ["print-object"],
}
PLACED = ["direction", "staccato", "strong-accent", "accent", "tenuto", "detached-legato", "stressed", "unstressed", "tuplet"]
# What stays in force from measure to measure.
CARRIED = ["divisions", "time", "key", "clef"]


def strip_attributes(nodes: DataFrame) -> DataFrame:
    """``nodes`` without coordinates and styles everywhere, and what ``BY_TAG`` and ``PLACED`` name on their elements."""
    gone = F.array(*map(F.lit, COORDINATES + STYLES))
    more = F.lit(None).cast("array<string>")
    for tag, names in (BY_TAG | {t: ["placement"] for t in PLACED}).items():
        more = F.when(F.col("tag") == tag, F.array(*map(F.lit, names))).otherwise(more)
    kept = F.map_filter("attrs", lambda k, v: ~F.array_contains(gone, k) & ~F.coalesce(F.array_contains(more, k), F.lit(False)))
    return nodes.withColumn("attrs", kept)


def strip_elements(nodes: DataFrame, keys: list[str], signatures: bool = True) -> DataFrame:
    """``nodes`` less page matter; with ``signatures``, less the time signatures too, which are set anew."""
    up = parent()["tag"]
    gone = (
        ((F.size("anc") == 2) & F.col("tag").isin(TOP_LEVEL))
        | ((up == "score-part") & (F.size("anc") == 4) & F.col("tag").isin(OF_SCORE_PART))
        | ((up == "measure") & (F.col("tag") == "print"))
    )
    if signatures:
        gone = gone | ((F.size("anc") == 5) & (up == "attributes") & (F.col("tag") == "time"))
    return without_subtrees(nodes, keys, F.coalesce(gone, F.lit(False)))


def measures(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys part_id part_node measure_node number``: the measures of every part."""
    here = (F.size("anc") == 3) & (F.col("tag") == "measure") & (parent()["tag"] == "part")
    found = nodes.where(here).select(*keys, parent()["id"].alias("part_node"), F.col("node_id").alias("measure_node"), F.col("last_id").alias("measure_last"), F.col("attrs")["number"].alias("number"))
    parts = nodes.where((F.size("anc") == 2) & (F.col("tag") == "part")).select(*keys, F.col("node_id").alias("part_node"), F.col("attrs")["id"].alias("part_id"))
    return found.join(parts, [*keys, "part_node"])


def events(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys measure_node node_id kind duration has_chord`` of notes, backups and forwards in document order."""
    here = (F.size("anc") == 4) & F.col("tag").isin("note", "backup", "forward") & (parent()["tag"] == "measure")
    own = nodes.where(here).select(*keys, parent()["id"].alias("measure_node"), "node_id", F.col("tag").alias("kind"))
    part = nodes.where((F.size("anc") == 5) & F.col("tag").isin("duration", "chord"))
    of = part.groupBy(*keys, parent()["id"].alias("node_id")).agg(
        F.min_by(F.when(F.col("tag") == "duration", F.coalesce("text", F.lit(""))), F.when(F.col("tag") == "duration", F.col("node_id"))).alias("duration"),
        F.bool_or(F.col("tag") == "chord").alias("has_chord"),
    )
    return own.join(of, [*keys, "node_id"], "left").fillna({"has_chord": False})


def measure_facts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`measures` with ``span divisions beats beat_type``: the first of each kind in a measure, null without."""
    up, up2 = parent()["tag"], parent(2)["tag"]
    of = lambda k: F.get("anc", F.lit(2))["id"]  # noqa: E731, ARG005
    # the first time element decides: a later one's beats don't fill up what it lacks
    wanted = nodes.where(
        ((F.size("anc") == 5) & (up == "attributes") & (F.col("tag") == "divisions"))
        | ((F.size("anc") == 6) & (up == "time") & (up2 == "attributes") & F.col("tag").isin("beats", "beat-type"))
    )
    first = lambda tag: F.min_by(F.when(F.col("tag") == tag, F.trim("text")), F.when(F.col("tag") == tag, F.col("node_id")))
    facts = wanted.groupBy(*keys, of(2).alias("measure_node")).agg(
        F.nullif(first("divisions"), F.lit("")).try_cast("long").alias("divisions"),
        first("beats").try_cast("long").alias("beats"), first("beat-type").try_cast("long").alias("beat_type"),
    )
    spans = timing.measure_span(events(nodes, keys), [*keys, "measure_node"], ["node_id"]).select(*keys, "measure_node", "span")
    return measures(nodes, keys).join(facts, [*keys, "measure_node"], "left").join(spans, [*keys, "measure_node"], "left")


def signature_changes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys part_node measure_node sig_beats sig_beat_type`` where a part's signature is to be written.

    The first part's lengths decide for all parts.
    """
    facts = measure_facts(nodes, keys)
    lead = facts.groupBy(*keys).agg(F.min("part_node").alias("part_node"))
    first = timing.effective_signatures(facts.join(lead, [*keys, "part_node"], "left_semi"), keys, ["measure_node"])
    every = timing.by_position(facts.select(*keys, "part_node", "measure_node"), first, keys, ["part_node"], ["measure_node"])
    return timing.changes(every, [*keys, "part_node"], ["measure_node"])


def _element(at, tag: str, depth: int, sub, text=None):
    """A new element's columns; its ancestors need tags alone."""
    above = F.slice(F.col(at), 1, depth)
    anc = F.concat(above, F.array(F.struct(F.lit(None).cast("int").alias("id"), F.lit(tag).alias("tag"), F.lit(None).cast("string").alias("tail"))))
    return F.struct(sub.alias("sub"), F.lit(tag).alias("tag"), (F.lit(None).cast("string") if text is None else text.cast("string")).alias("text"), anc.alias("anc"))


def anchors(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys measure_node attributes_node after``: each measure's first attributes and the node after which new ones go."""
    up = parent()["tag"]
    attr = nodes.where((F.size("anc") == 4) & (F.col("tag") == "attributes") & (up == "measure")).groupBy(*keys, parent()["id"].alias("measure_node")).agg(F.min("node_id").alias("attributes_node"))
    div = nodes.where((F.size("anc") == 5) & (up == "attributes") & (F.col("tag") == "divisions")).groupBy(*keys, parent()["id"].alias("attributes_node")).agg(F.min_by("last_id", "node_id").alias("_div"))
    return attr.join(div, [*keys, "attributes_node"], "left").select(*keys, "measure_node", "attributes_node", F.coalesce("_div", "attributes_node").alias("after"))


def _at_measures(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the measure's ancestors and :func:`anchors`."""
    here = nodes.where((F.size("anc") == 3) & (F.col("tag") == "measure")).select(*keys, F.col("node_id").alias("measure_node"), F.col("anc").alias("_anc"))
    return rows.join(here, [*keys, "measure_node"]).join(anchors(nodes, keys), [*keys, "measure_node"], "left")


def _with_attributes(anc: str = "_anc"):
    return F.concat(F.col(anc), F.array(F.struct(F.lit(None).cast("int").alias("id"), F.lit("attributes").alias("tag"), F.lit(None).cast("string").alias("tail"))))


def cleaned_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes of the cleaned scores with their place ``(node_id, sub)``: page matter and styles gone, signatures recomputed."""
    kept = strip_attributes(strip_elements(nodes, keys))
    put = _at_measures(signature_changes(nodes, keys), kept, keys).withColumn("_in", _with_attributes())
    new = F.array(
        F.when(F.col("attributes_node").isNull(), _element("_in", "attributes", 3, F.lit(1))),
        _element("_in", "time", 4, F.lit(2)),
    )
    beats = F.concat(F.col("_in"), F.array(F.struct(F.lit(None).cast("int").alias("id"), F.lit("time").alias("tag"), F.lit(None).cast("string").alias("tail"))))
    put = put.withColumn("_time", beats)
    new = F.concat(new, F.array(_element("_time", "beats", 5, F.lit(3), F.col("sig_beats")), _element("_time", "beat-type", 5, F.lit(4), F.col("sig_beat_type"))))
    added = put.select(
        *keys, F.coalesce("after", "measure_node").alias("node_id"), F.explode(F.filter(new, lambda x: x.isNotNull())).alias("e")
    ).select(*keys, "node_id", "e.sub", "e.tag", F.create_map().cast("map<string,string>").alias("attrs"), "e.text", F.lit(None).cast("string").alias("tail"), "e.anc")
    return kept.select(*keys, "node_id", F.lit(0).alias("sub"), "tag", "attrs", "text", "tail", "anc").unionByName(added)


def clean(documents: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """``keys xml``: cleaned documents with declaration and, where there was one, document type."""
    nodes = materialize(xml_nodes(documents, keys, xml).where("node_id >= 0"))
    body = serialize(cleaned_nodes(nodes, keys), keys, ["node_id", "sub"], "_body")
    types = documents.select(*keys, doctype(F.col(xml)).alias("_type"))
    top = F.lit('<?xml version="1.0" encoding="UTF-8"?>')
    return body.join(types, keys).select(*keys, F.concat_ws("\n", top, "_type", "_body").alias(xml))


def snippets(nodes: DataFrame, systems: DataFrame, keys: list[str], carry_to: str = "system") -> DataFrame:
    """``keys kind global_id xml``: a document per system and per measure of it.

    ``systems``: ``keys system_id first last``. A snippet has the part list and, of
    each part, the measures that the first part has. Its first measure gets what is in
    force at the system's start and it doesn't set itself; with ``carry_to`` "measure",
    a measure's snippet gets what is in force at that measure instead.
    """
    by_score = Window.partitionBy(*keys).orderBy("first")
    whole = Window.partitionBy(*keys)
    ordered = systems.withColumns({"_sys": F.row_number().over(by_score), "_n": F.count(F.lit(1)).over(whole)})
    own = measures(nodes, keys).withColumn("number", F.col("number").try_cast("int"))
    parts = own.select(*keys, "part_node").distinct()
    got = slicing.slice_measures(ordered.join(parts, keys), own, [*keys, "part_node"], "number", ["measure_node"])
    lead = own.groupBy(*keys).agg(F.min("part_node").alias("part_node"))
    got = slicing.aligned(got, [*keys, "system_id"], "part_node", "number", got.join(lead, [*keys, "part_node"], "left_semi")).where("found")

    attribute = nodes.where((F.size("anc") == 5) & (parent()["tag"] == "attributes") & F.col("tag").isin(CARRIED))
    attribute = attribute.select(
        *keys, F.get("anc", F.lit(2))["id"].alias("measure_node"), F.get("anc", F.lit(3))["id"].alias("attributes_node"),
        F.col("node_id").alias("element"), "tag", F.col("attrs")["number"].alias("key_number"),
    )
    sized = got.withColumn("_m", F.row_number().over(Window.partitionBy(*keys, "part_node").orderBy("_sys", "number")))
    sized = sized.withColumn("_m_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "part_node")))
    of_measure = attribute.join(sized.select(*keys, "part_node", "measure_node", "_sys", "_n", "_m", "_m_n"), [*keys, "measure_node"])
    key = ["tag", "key_number"]
    by_system = carry.in_force(of_measure, [*keys, "part_node"], key, "_sys", ["element"], "element", "_n")
    if carry_to == "measure":
        by_measure = carry.in_force(of_measure, [*keys, "part_node"], key, "_m", ["element"], "element", "_m_n")

    first_of = Window.partitionBy(*keys, "part_node", "system_id").orderBy("number")
    rows = sized.withColumn("_at", F.row_number().over(first_of))
    cols = [*keys, "kind", "global_id", "part_node", "measure_node", "_sys", "_m", "_at"]
    pieces = rows.select(*keys, F.lit("system").alias("kind"), F.col("system_id").alias("global_id"), "part_node", "measure_node", "_sys", "_m", "_at").unionByName(
        rows.select(*keys, F.lit("measure").alias("kind"), F.col("number").alias("global_id"), "part_node", "measure_node", "_sys", "_m", F.lit(1).alias("_at"))
    ).select(*cols)
    snippet = [*keys, "kind", "global_id"]

    # what is put into first measures
    firsts = pieces.where("_at = 1")
    if carry_to == "measure":
        carried = firsts.where("kind = 'system'").join(by_system, [*keys, "part_node", "_sys"]).drop("_m").unionByName(
            firsts.where("kind = 'measure'").drop("_sys").join(by_measure, [*keys, "part_node", "_m"]).withColumnRenamed("_m", "_sys")
        )
    else:
        carried = firsts.join(by_system, [*keys, "part_node", "_sys"]).drop("_m")
    present = attribute.join(anchors(nodes, keys).select(*keys, "attributes_node"), [*keys, "attributes_node"], "left_semi")
    added = _at_measures(carry.missing(carried, present, [*keys, "measure_node"], key), nodes, keys)
    subtree = nodes.where((F.size("anc") >= 5) & (F.get("anc", F.lit(3))["tag"] == "attributes")).select(
        *keys, F.get("anc", F.lit(4))["id"].alias("element"), F.col("node_id").alias("_own"), F.col("tag").alias("_tag"), "attrs", "text", "tail", "anc"
    )
    spot = [F.coalesce("after", "measure_node").alias("node_id")]
    put = added.join(subtree, [*keys, "element"]).select(
        *snippet, *spot, F.struct(F.col("key_order").cast("int").alias("a"), F.col("_own").alias("b")).alias("sub"), F.col("_tag").alias("tag"), "attrs", "text", "tail", "anc"
    )
    bare = added.where(F.col("attributes_node").isNull()).select(*snippet, "measure_node", "_anc").dropDuplicates([*snippet, "measure_node"]).select(
        *snippet, F.col("measure_node").alias("node_id"), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")).alias("sub"), F.lit("attributes").alias("tag"),
        F.create_map().cast("map<string,string>").alias("attrs"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("tail"), _with_attributes().alias("anc"),
    )

    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("sub")
    plain = nodes.select(*keys, "node_id", zero, "tag", "attrs", "text", "tail", "anc")
    each = plain.where(F.size("anc") >= 3).withColumn("measure_node", F.get("anc", F.lit(2))["id"])
    bodies = pieces.select(*snippet, "measure_node").join(each, [*keys, "measure_node"]).drop("measure_node")
    frame = plain.where(
        (F.size("anc") == 1) | ((F.size("anc") == 2) & (F.col("tag") == "part")) | (F.get("anc", F.lit(1))["tag"] == "part-list")
    ).withColumn(
        "attrs",
        F.when(F.size("anc") == 1, F.map_filter("attrs", lambda k, v: k == "version"))
        .when((F.size("anc") == 2) & (F.col("tag") == "part"), F.map_filter("attrs", lambda k, v: k == "id"))
        .otherwise(F.col("attrs")),
    )
    frames = pieces.select(*snippet).distinct().join(frame, keys)
    every = frames.unionByName(bodies.select(*frames.columns)).unionByName(put.select(*frames.columns)).unionByName(bare.select(*frames.columns))
    body = serialize(every, snippet, ["node_id", "sub"], "_body")
    return body.select(*snippet, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), F.col("_body")).alias("xml"))


def snippet_names(rows: DataFrame) -> DataFrame:
    """``rows`` with ``name``: ``systems/system_0001.xml`` and ``measures/measure_0001.xml``."""
    return rows.withColumn("name", F.concat(F.col("kind"), F.lit("s/"), F.col("kind"), F.format_string("_%04d.xml", F.col("global_id").cast("long"))))
