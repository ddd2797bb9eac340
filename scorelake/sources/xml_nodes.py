"""XML documents as node tables that keep the order of all elements, and back.

Spark's own XML reader groups children by tag, so their order across tags is lost;
timing in scores depends on it. Parsing is the one step in Python: a document a
row, its elements in preorder. All that follows is joins, windows and aggregates.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``anc``: the element's ancestors from the root down to itself. ``last_id``: the last id of its subtree.
NODES = (
    "node_id int, last_id int, tag string, attrs map<string,string>, text string, tail string, "
    "anc array<struct<id:int,tag:string,tail:string>>"
)


def _rows(xml: str):
    """Elements in preorder, without recursion."""
    out = []
    stack = [(ElementTree.fromstring(xml), [])]
    while stack:
        el, anc = stack.pop()
        if el is None:
            out[anc]["last_id"] = len(out) - 1
            continue
        if not isinstance(el.tag, str):  # comments and instructions
            continue
        k = len(out)
        anc = [*anc, {"id": k, "tag": el.tag, "tail": el.tail}]
        out.append({"node_id": k, "last_id": k, "tag": el.tag, "attrs": list(el.attrib.items()), "text": el.text, "tail": el.tail, "anc": anc})
        stack.append((None, k))
        stack.extend((c, anc) for c in reversed(el))
    return out


def xml_nodes(documents: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """``keys`` and :data:`NODES` for every element; one row with ``node_id`` -1 and the message as text for what can't be parsed.

    A null or blank document has no rows.
    """
    fields = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys)
    node = pa.struct([("id", pa.int32()), ("tag", pa.string()), ("tail", pa.string())])
    kinds = {"node_id": pa.int32(), "last_id": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "tail": pa.string(), "anc": pa.list_(node)}

    def task(batches):
        for batch in batches:
            for i, x in enumerate(batch.column(len(keys)).to_pylist()):
                if not (x or "").strip():
                    continue
                try:
                    rows = _rows(x)
                except ElementTree.ParseError as e:
                    rows = [{"node_id": -1, "last_id": -1, "tag": None, "attrs": [], "text": str(e), "tail": None, "anc": []}]
                same = pa.array([i] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).take(same) for j in range(len(keys))), *(pa.array([r[c] for r in rows], t) for c, t in kinds.items())],
                    names=[*keys, *kinds],
                )

    return documents.select(*keys, xml).mapInArrow(task, f"{fields}, {NODES}" if fields else NODES)


def parent(offset: int = 1) -> Column:
    """The ancestor so many levels up: ``STRUCT<id, tag, tail>``, null beyond the root."""
    return F.get("anc", F.size("anc") - 1 - offset)


def path() -> Column:
    """Tags from the root down, parted by slashes."""
    return F.array_join(F.transform("anc", lambda a: a["tag"]), "/")


def child_text(nodes: DataFrame, keys: list[str], tag: str, name: str) -> DataFrame:
    """``keys node_id name``: the text of each element's first child of that tag."""
    own = nodes.where(F.col("tag") == tag).select(*keys, parent()["id"].alias("_p"), "node_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.groupBy(*keys, "_p").agg(F.min_by("text", "node_id").alias(name)).withColumnRenamed("_p", "node_id")


def without_subtrees(nodes: DataFrame, keys: list[str], gone: Column) -> DataFrame:
    """``nodes`` less the elements marked by ``gone`` and all below them, by one window in preorder."""
    so_far = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(gone, F.col("last_id"))).over(so_far)
    return nodes.withColumn("_reach", reach).where(F.coalesce(F.col("_reach") < F.col("node_id"), F.lit(True))).drop("_reach")


def _safe(c: Column, attribute: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#09;")) if attribute else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def serialize(nodes: DataFrame, keys: list[str], order: list[str], xml: str = "xml") -> DataFrame:
    """``keys xml``: one indented document per key from rows in document order.

    Rows need ``tag attrs text tail anc``; depth is the length of ``anc``, and only
    the tags and tails in it are used. White space between elements is laid anew.
    """
    at = Window.partitionBy(*keys).orderBy(*order)
    depth = F.size("anc") - 1
    rows = nodes.select(*keys, *order, "tag", "attrs", "text", "tail", "anc", depth.alias("_d"))
    rows = rows.withColumn("_next", F.lead("_d", 1, 0).over(at))
    full = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) != ""
    text = F.when(full, _safe(F.col("text"))).otherwise("")
    tail_of = lambda c: F.when(F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) != "", _safe(c)).otherwise("")
    attrs = F.array_join(
        F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _safe(e["value"], True), F.lit('"'))), ""
    )
    start = F.concat(F.repeat(F.lit("  "), F.col("_d")), F.lit("<"), F.col("tag"), F.coalesce(attrs, F.lit("")))
    has_children = F.col("_next") > F.col("_d")
    one = (
        F.when(has_children, F.concat(start, F.lit(">"), text))
        .when(full, F.concat(start, F.lit(">"), text, F.lit("</"), F.col("tag"), F.lit(">"), tail_of(F.col("tail"))))
        .otherwise(F.concat(start, F.lit(" />"), tail_of(F.col("tail"))))
    )
    levels = F.when(F.col("_next") < F.col("_d"), F.reverse(F.sequence(F.col("_next"), F.col("_d") - 1))).otherwise(F.array().cast("array<int>"))
    ends = F.transform(levels, lambda k: F.concat(F.repeat(F.lit("  "), k), F.lit("</"), F.get("anc", k)["tag"], F.lit(">"), tail_of(F.get("anc", k)["tail"])))
    rows = rows.withColumn("_line", F.array_join(F.concat(F.array(one), ends), "\n"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("_l")).select(
        *keys, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias(xml)
    )
