"""Pages of PDF files by joins over their object tables (``sources.pdf_objects``).

The tree of pages is walked level by level: each round joins the inner nodes that the
round before reached to their children, so there are as many rounds as the deepest
tree has levels. A page has its own resources or those of the nearest node above it.

Defined results: a reference to nothing is no page; an inner node that contains itself
isn't walked again (``problems`` tells it); a file without a tree has no pages. Files are
told apart by ``keys``; columns of the names used here may not be among them.

A file is parsed by one task as a whole. :func:`read_pages` walks its tree there and then and
reads only the objects on the way, so no node is moved; :func:`pages` needs the node table.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.artifacts import vector_documents
from scorelake.sources.pdf_objects import TRAILER, Broken, File
from scorelake.sources.tables import materialize


def _entries(nodes: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """``keys object parent key to at``: the entries of these names, and where their values stand (object and node)."""
    found = nodes.where(F.col("key").isin(*names) & (F.col("kind") != "null"))
    return found.select(*keys, "object", "parent", "key", "value", F.coalesce("target", "object").alias("to"), F.when(F.col("target").isNotNull(), 0).otherwise(F.col("node")).alias("at"))


def _tree(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``keys object is_inner r_object r_node`` of what may stand in a tree (kept), and ``keys object ord child`` (kept)."""
    top = _entries(nodes, keys, "/Type", "/Kids", "/Resources").where("parent = 0")
    pick = lambda key, what: F.max(F.when(F.col("key") == key, what))
    own = top.groupBy(*keys, "object").agg(
        pick("/Type", F.col("value")).alias("type"), pick("/Kids", F.lit(True)).alias("kids"), pick("/Kids", F.struct("to", "at")).alias("list"), pick("/Resources", F.struct("to", "at")).alias("own"),
    )
    own = own.where("kids OR type = '/Page' OR own IS NOT NULL")
    own = materialize(own.withColumn("is_inner", F.coalesce(F.col("kids"), F.lit(False)) & F.coalesce(F.col("type") != "/Page", F.lit(True))))
    lists = own.where("is_inner").select(*keys, "object", F.col("list.to").alias("_to"), F.col("list.at").alias("_at"))
    child = nodes.where("kind = 'ref' AND key IS NULL").select(*keys, F.col("object").alias("_to"), F.col("parent").alias("_at"), "ord", F.col("target").alias("child"))
    return own.select(*keys, "object", "is_inner", "own"), materialize(lists.join(child, [*keys, "_to", "_at"]).select(*keys, "object", "ord", "child"))


def roots(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys object``: where each file's tree of pages begins."""
    root = _entries(nodes, keys, "/Root").where((F.col("object") == TRAILER) & (F.col("parent") == 0)).select(*keys, F.col("to").alias("object"), F.col("at").alias("parent"))
    return root.join(_entries(nodes, keys, "/Pages"), [*keys, "object", "parent"]).select(*keys, F.col("to").alias("object"))


def _leaves(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pages ``keys object place own`` (place: the way down the tree), and inner nodes that contain themselves."""
    own, children = _tree(nodes, keys)
    reached = roots(nodes, keys).select(*keys, "object", F.array().cast("array<int>").alias("place"), F.array().cast("array<long>").alias("above"), F.lit(None).cast("struct<to:long,at:int>").alias("given"))
    leaves = loops = None
    while True:
        step = reached.join(own, [*keys, "object"]).withColumn("given", F.coalesce("own", "given")).drop("own")
        again = F.array_contains("above", F.col("object"))
        step = materialize(step.withColumn("again", again))
        found, looped = step.where("NOT is_inner").select(*keys, "object", "place", "given"), step.where("is_inner AND again").select(*keys, "object")
        leaves, loops = (found, looped) if leaves is None else (leaves.unionByName(found), loops.unionByName(looped))
        inner = step.where("is_inner AND NOT again")
        if inner.isEmpty():
            return leaves, loops
        reached = inner.join(children, [*keys, "object"]).select(*keys, F.col("child").alias("object"), F.array_append("place", F.col("ord")).alias("place"), F.array_append("above", F.col("object")).alias("above"), "given")


def pages(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys page object has_resources n_objects n_images`` of :func:`pdf_nodes` (kept), pages from 1 in the file's order.

    ``n_objects`` counts the external objects that a page's resources name, ``n_images`` those that are images.
    """
    leaves, _ = _leaves(nodes, keys)
    leaves = leaves.withColumn("page", F.row_number().over(Window.partitionBy(*keys).orderBy("place")))
    leaves = materialize(leaves.select(*keys, "page", "object", F.col("given.to").alias("_to"), F.col("given.at").alias("_at")))
    # dictionaries by where they stand: several pages may share one
    used = leaves.select(*keys, "_to", "_at").where("_to IS NOT NULL").distinct()
    inside = nodes.where("key IS NOT NULL AND kind != 'null'").select(
        *keys, F.col("object").alias("_to"), F.col("parent").alias("_at"), "key", "value", F.coalesce("target", "object").alias("_to2"), F.when(F.col("target").isNotNull(), 0).otherwise(F.col("node")).alias("_at2")
    )
    one = used.join(inside, [*keys, "_to", "_at"])
    filled = one.groupBy(*keys, "_to", "_at").agg(F.lit(True).alias("has_resources"))
    external = one.where("key = '/XObject'").select(*keys, F.col("_to").alias("_of"), F.col("_at").alias("_of_at"), F.col("_to2").alias("_to"), F.col("_at2").alias("_at"))
    named = external.join(inside, [*keys, "_to", "_at"]).select(*keys, "_of", "_of_at", F.col("_to2").alias("_to"), F.col("_at2").alias("_at"), F.col("key").alias("name"))
    images = inside.where("key = '/Subtype' AND value = '/Image'").select(*keys, "_to", "_at", F.lit(1).alias("image"))
    counted = named.join(images, [*keys, "_to", "_at"], "left").groupBy(*keys, F.col("_of").alias("_to"), F.col("_of_at").alias("_at"))
    counted = counted.agg(F.count("name").alias("n_objects"), F.count("image").alias("n_images"))
    found = leaves.join(filled, [*keys, "_to", "_at"], "left").join(counted, [*keys, "_to", "_at"], "left")
    return found.select(*keys, "page", "object", F.coalesce("has_resources", F.lit(False)).alias("has_resources"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_objects", "n_images")))


#: What a file or an object that can't be read raises.
_UNREAD = (Broken, ValueError, KeyError, IndexError, TypeError, RecursionError, zlib.error)


def _file_pages(f: File) -> list[tuple[int, int, bool, int, int]]:
    """``page object has_resources n_objects n_images`` of a file, as :func:`pages` has them."""
    seen: dict = {TRAILER: f.trailer}

    def value(n):
        if n not in seen:
            try:
                seen[n] = f.object(n) if n in f.places and f.places[n][1] != -2 else None
            except _UNREAD:
                seen[n] = None
        return seen[n]

    def entries(x) -> dict:
        """What a dictionary, or one that a reference names, holds but nulls."""
        x = value(x[1]) if isinstance(x, tuple) else x
        return {k: v for k, v in x.items() if v is not None} if isinstance(x, dict) else {}

    counted: dict = {}

    def count(resources):
        if not isinstance(resources, tuple) or resources not in counted:
            held = entries(resources)
            named = [entries(x) for x in entries(held.get("/XObject")).values()]
            found = bool(held), len(named), sum(x.get("/Subtype") == "/Image" for x in named)
            if not isinstance(resources, tuple):
                return found
            counted[resources] = found
        return counted[resources]

    top = entries(f.trailer.get("/Root")).get("/Pages")
    found = []
    # a page tree begins at an object of the file
    todo = [(top[1], None, ())] if isinstance(top, tuple) else []
    while todo:
        n, given, above = todo.pop()
        own = entries(("ref", n))
        kids, kind = own.get("/Kids"), own.get("/Type")
        given = own.get("/Resources", given)
        if kids is not None and kind != "/Page":
            if n not in above:
                kids = value(kids[1]) if isinstance(kids, tuple) else kids
                todo += [(x[1], given, (*above, n)) for x in reversed(kids if isinstance(kids, list) else []) if isinstance(x, tuple)]
        elif kids is not None or kind == "/Page" or "/Resources" in own:
            found.append((len(found) + 1, n, *count(given)))
    return found


def read_pages(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys is_vector error page object has_resources n_objects n_images``: the pages of each file in its order, one row without a page where there is none.

    ``is_vector`` is told of the file, as by :func:`vector_files`.
    """
    fields = "".join(f"`{k}` {files.schema[k].dataType.simpleString()}, " for k in keys)
    kinds = {"is_vector": pa.bool_(), "error": pa.string(), "page": pa.int32(), "object": pa.int64(), "has_resources": pa.bool_(), "n_objects": pa.int64(), "n_images": pa.int64()}

    def task(batches):
        known: dict = {}
        for batch in batches:
            at, rows = [], []
            for i, raw in enumerate(batch.column(len(keys))):
                try:
                    f, error = File(raw.as_py() or b"", known), None
                except _UNREAD as e:
                    f, error = None, str(e) or type(e).__name__
                found = _file_pages(f) if f else []
                is_vector = not all(p[2] and p[3] and p[4] for p in found)
                got = [(is_vector, None, *p) for p in found] or [(False, error, *[None] * 5)]
                at += [i] * len(got)
                rows += got
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(at, pa.int32())) for j in range(len(keys))), *(pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True))], names=[*keys, *kinds])

    return files.select(*keys, content).mapInArrow(task, f"{fields}is_vector boolean, error string, page int, object long, has_resources boolean, n_objects long, n_images long")


def vector_files(pages: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys is_vector`` of every file: whether any of its pages has no image; without pages it's none."""
    found = files.select(*keys).distinct().join(vector_documents(pages, keys), keys, "left")
    return found.select(*keys, F.coalesce("is_vector", F.lit(False)).alias("is_vector"))


def page_range(pages: DataFrame, keys: list[str], first, last) -> DataFrame:
    """The pages first to last of each file; a file with fewer pages stops the job, as a range beyond its end can't be meant."""
    total = pages.groupBy(*keys).agg(F.max("page").alias("_pages"))
    told = F.raise_error(F.concat(F.lit("the page range ends after the file's last page, "), F.col("_pages").cast("string"))).cast("boolean")
    return pages.join(total, keys).where(F.when(last <= F.col("_pages"), F.col("page").between(first, last)).otherwise(told)).drop("_pages")


def problems(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys object error``: files and objects that can't be read, and inner nodes of a tree that contain themselves."""
    unread = nodes.where("error IS NOT NULL").select(*keys, "object", "error")
    return unread.unionByName(_leaves(nodes, keys)[1].distinct().withColumn("error", F.lit("contains itself")))
