"""Recognition archives to layouts: sheets, systems, measures and their boxes.

An archive holds ``book.xml`` and a document per sheet. Both become node tables;
the rest is joins by archive and sheet, and windows within a sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.geometry import crop_rect, measure_box, padding
from scorelake.operators import cutouts, layout
from scorelake.sources.archives import members
from scorelake.sources.tables import materialize
from scorelake.sources.xml_nodes import parent, path, xml_nodes

# Names of an archive's documents.
BOOK, SHEET = r"book\.xml", r"sheet#(\d+)/sheet#\1\.xml"
#: Layouts as JSON documents hold them.
BOX = "struct<x:int,y:int,width:int,height:int>"
SCHEMA = (
    f"array<struct<sheet:int,width:int,height:int,systems:array<struct<global_id:int,local_id:int,bounds:{BOX},"
    f"measure_range:array<int>,measures:array<struct<local_id:int,global_id:int,bounds:{BOX}>>>>>>"
)


def _number(name: str):
    return F.col("attrs")[name].try_cast("int")


def _first(nodes: DataFrame, group: list[str], node: str) -> DataFrame:
    """``group node``: the first of each group in document order."""
    return nodes.groupBy(*group).agg(F.min("node_id").alias(node))


#: Why an archive has no layout; ``unlisted`` alone stops none.
REASONS = ("archive", "member", "not XML", "empty", "no book", "missing sheet", "sheet twice", "no size", "unlisted")


def texts(archives: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys name sheet xml error`` (kept): the documents of all archives, sheet null for the book; what can't be read has an error.

    An archive that can't be opened is one row without a name, so is one without such documents.
    """
    found = members(archives, keys, content, f"{BOOK}|{SHEET}")
    number = F.nullif(F.regexp_extract("name", SHEET, 1), F.lit("")).try_cast("int")
    table = materialize(found.select(*keys, "name", number.alias("sheet"), F.col("data").cast("string").alias("xml"), "error"))
    none = archives.select(*keys).distinct().join(table.select(*keys), keys, "left_anti")
    blank = (F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("sheet", "int"), ("xml", "string")))
    return table.unionByName(none.select(*keys, *blank, F.lit("no documents").alias("error")))


def node_table(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (kept) of :func:`texts`: ``keys sheet`` (null for the book) and the node columns; ``node_id`` -1 where a text is no XML."""
    return materialize(xml_nodes(documents.where("xml IS NOT NULL").select(*keys, "sheet", "xml"), [*keys, "sheet"]))


def documents(archives: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Nodes (kept) of all books and sheets that can be read."""
    return node_table(texts(archives, keys, content), keys).where("node_id >= 0")


def problems(found: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys name reason detail fatal`` (kept) of :func:`texts` and their nodes: what is wrong with which archive, by ``REASONS``.

    The book's sheets are held against those that were read, both ways; a sheet without the size of its page counts as
    unreadable. Only a sheet that the book doesn't list leaves its archive's layout as it is.
    """
    told = lambda rows, reason, name="name", detail=None: rows.select(
        *keys, F.col(name).alias("name") if name else F.lit(None).cast("string").alias("name"), reason if not isinstance(reason, str) else F.lit(reason).alias("reason"),
        (F.col(detail) if detail else F.lit(None).cast("string")).alias("detail"),
    )
    file = F.when(F.col("sheet").isNull(), "book.xml").otherwise(F.concat(F.lit("sheet#"), F.col("sheet").cast("string"), F.lit("/sheet#"), F.col("sheet").cast("string"), F.lit(".xml"))).alias("name")
    unread = told(found.where("error IS NOT NULL"), F.when(F.col("name").isNull(), "archive").otherwise("member").alias("reason"), detail="error")
    broken = told(nodes.where("node_id = -1").select(*keys, file, "text"), "not XML", detail="text")
    empty = told(found.where("error IS NULL AND trim(coalesce(xml, '')) RLIKE '^\\\\s*$'"), "empty")
    opened = found.groupBy(*keys).agg(F.bool_or(F.col("name").isNull()).alias("_shut"), F.bool_or(F.col("name").isNotNull() & F.col("sheet").isNull()).alias("_book"))
    bookless = told(opened.where("NOT _shut AND NOT _book"), "no book", None)
    listed = book_sheets(nodes.where("node_id >= 0"), keys).groupBy(*keys, "sheet").agg(F.count(F.lit(1)).alias("_n"))
    have = found.where("sheet IS NOT NULL").select(*keys, "sheet").distinct()
    lost = told(listed.join(have, [*keys, "sheet"], "left_anti").select(*keys, file), "missing sheet")
    twice = told(listed.where("_n > 1").select(*keys, file), "sheet twice")
    own = nodes.where("node_id >= 0 AND sheet IS NOT NULL")
    size = _number("width").isNotNull() & _number("height").isNotNull()
    sized = own.groupBy(*keys, "sheet").agg(F.min_by(F.when(path() == "sheet/picture", size), F.when(path() == "sheet/picture", F.col("node_id"))).alias("_ok"))
    bare = told(sized.where("NOT coalesce(_ok, false)").join(listed, [*keys, "sheet"], "left_semi").select(*keys, file), "no size")
    # a book that can't be read lists nothing: its sheets aren't told one by one
    books = nodes.where("node_id = 0 AND sheet IS NULL").select(*keys).distinct()
    unlisted = told(have.join(books, keys, "left_semi").join(listed, [*keys, "sheet"], "left_anti").select(*keys, file), "unlisted")
    every = unread
    for part in (broken, empty, bookless, lost, twice, bare, unlisted):
        every = every.unionByName(part)
    return materialize(every.withColumn("fatal", F.col("reason") != "unlisted"))


def book_sheets(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys sheet declared place``: a book's sheets in its order, with the measures that their first page declares."""
    own = nodes.where(F.col("sheet").isNull())
    sheets = own.where(path() == "book/sheet").select(*keys, F.col("node_id").alias("place"), _number("number").alias("sheet"))
    page = own.where(path() == "book/sheet/page").groupBy(*keys, parent()["id"].alias("place")).agg(F.min_by(_number("delta-measure-id"), "node_id").alias("declared"))
    return sheets.join(page, [*keys, "place"], "left").select(*keys, "sheet", F.coalesce("declared", F.lit(0)).alias("declared"), "place")


def book_version(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys version``: of the program that wrote the book."""
    return nodes.where(F.col("sheet").isNull() & (path() == "book")).select(*keys, F.coalesce(F.col("attrs")["software-version"], F.lit("")).alias("version"))


def read(archives: DataFrame, keys: list[str], content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Layouts (:func:`layouts_of`) and problems (:func:`problems`): each archive has a layout or a fatal problem."""
    found = texts(archives, keys, content)
    nodes = node_table(found, keys)
    told = problems(found, nodes, keys)
    bad = told.where("fatal").select(*keys).distinct()
    good = layouts_of(nodes.where("node_id >= 0").join(bad, keys, "left_anti"), keys)
    every = found.select(*keys).distinct().join(bad, keys, "left_anti")
    # a book without sheets has a layout without any
    return every.join(good, keys, "left").select(*keys, F.coalesce("sheets", F.array().cast(good.schema["sheets"].dataType)).alias("sheets")), told


def layouts(archives: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys sheets`` of the archives without a fatal problem; :func:`read` tells the others."""
    return read(archives, keys, content)[0]


def layouts_of(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys sheets``: the nested layout of each archive, from the nodes of its book and sheets.

    A sheet's first page counts, and of a system its first part's staves. Stacks
    stand from left to right, and measures are numbered in that order: within the
    sheet, and over sheets from the numbers of measures that the book declares.
    """
    book = book_sheets(nodes, keys)
    sheet = [*keys, "sheet"]
    own = nodes.join(book.select(*sheet), sheet, "left_semi")
    at = lambda p: own.where(path() == p)
    up = lambda k, name: parent(k)["id"].alias(name)

    picture = at("sheet/picture").groupBy(*sheet).agg(F.min_by(_number("width"), "node_id").alias("width"), F.min_by(_number("height"), "node_id").alias("height"))
    space = at("sheet/scale/interline").groupBy(*sheet).agg(F.min_by(F.col("attrs")["main"], "node_id").alias("interline"))
    sized = picture.join(space, sheet, "left").withColumn("padding", padding(F.col("interline")))

    page = _first(at("sheet/page"), sheet, "page")
    systems = at("sheet/page/system").select(*sheet, up(1, "page"), F.col("node_id").alias("system"), _number("id").alias("system_id")).join(page, [*sheet, "page"], "left_semi")
    system = [*sheet, "system"]
    stacks = at("sheet/page/system/stack").select(*sheet, up(1, "system"), "node_id", _number("id").alias("stack_id"), _number("left").alias("left"), _number("right").alias("right"))
    stacks = stacks.join(systems.select(*system, "system_id"), system)

    part = _first(at("sheet/page/system/part").select(*sheet, up(1, "system"), "node_id"), system, "part")
    staff = at("sheet/page/system/part/staff").select(*sheet, up(2, "system"), up(1, "part"), F.col("node_id").alias("staff"), _number("left").alias("left"), _number("right").alias("right"))
    staff = staff.join(part, [*system, "part"], "left_semi")
    lines = _first(at("sheet/page/system/part/staff/lines").select(*sheet, up(1, "staff"), "node_id"), [*sheet, "staff"], "lines")
    point = at("sheet/page/system/part/staff/lines/line/point").groupBy(*sheet, up(2, "lines"), up(1, "line")).agg(F.min_by(F.col("attrs")["y"].try_cast("double"), "node_id").alias("y"))
    line = at("sheet/page/system/part/staff/lines/line").select(*sheet, up(1, "lines"), F.col("node_id").alias("line")).join(point, [*sheet, "lines", "line"], "left")
    ends = line.groupBy(*sheet, "lines").agg(F.min_by("y", "line").alias("top"), F.max_by("y", "line").alias("bottom"))
    staves = staff.join(lines.join(ends, [*sheet, "lines"], "left"), [*sheet, "staff"], "left")

    sig = _first(at("sheet/page/system/sig").select(*sheet, up(1, "system"), "node_id"), system, "sig")
    inters = _first(at("sheet/page/system/sig/inters").select(*sheet, up(1, "sig"), "node_id"), [*sheet, "sig"], "inters")
    bounds = own.where((F.size("anc") == 7) & path().rlike("^sheet/page/system/sig/inters/[^/]+/bounds$"))
    bounds = bounds.groupBy(*sheet, up(4, "system"), up(3, "sig"), up(2, "inters"), up(1, "symbol")).agg(F.min_by("attrs", "node_id").alias("a"))
    bounds = bounds.join(sig, [*system, "sig"], "left_semi").join(inters, [*sheet, "sig", "inters"], "left_semi")
    glyphs = bounds.select(*system, *(F.col("a")[c].alias(c) for c in ("x", "y", "w", "h")))

    of_page = systems.join(sized.select(*sheet, "padding", F.col("height").alias("page_height")), sheet)
    boxed = layout.system_bounds(of_page, staves, glyphs, system)
    offsets = layout.sheet_offsets(book, keys, ["place"])
    measures = layout.measure_ids(stacks, keys, ["sheet"], ["system", "left", "node_id"], offsets)
    measures = measures.join(boxed.select(*system, F.col("bounds").alias("_of")), system)
    measures = measures.withColumn("bounds", measure_box(F.col("left"), F.col("right"), F.col("_of")))
    numbered = layout.system_ids(boxed, keys, ["sheet", "system"]).withColumn("local_id", F.col("system_id"))
    whole = book.join(sized.select(*sheet, "width", "height"), sheet).select(*sheet, "width", "height")
    as_int = lambda df: df.withColumns({c: F.col(c).cast("int") for c in ("local_id", "global_id")})
    return layout.nested(whole, as_int(numbered), as_int(measures), keys)


def to_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys json``: layouts as JSON documents."""
    return rows.select(*keys, F.to_json(F.struct("sheets")).alias("json"))


def from_json(rows: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """``keys sheets``: layouts read back; what isn't such a document has null sheets."""
    return rows.select(*keys, F.from_json(json, f"sheets {SCHEMA}")["sheets"].alias("sheets"))


def boxes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys sheet name rect``: what to cut out of page images, by file name: each system and each measure."""
    page = rows.select(*keys, F.explode("sheets").alias("p")).select(*keys, "p.*")
    each = page.select(*keys, "sheet", "width", "height", F.explode("systems").alias("s"))
    named = lambda kind, of: F.struct(F.format_string(f"{kind}s/{kind}_%04d.png", of["global_id"]).alias("name"), of["bounds"].alias("bounds"))
    parts = F.concat(F.array(named("system", F.col("s"))), F.transform("s.measures", lambda m: named("measure", m)))
    each = each.select(*keys, "sheet", "width", "height", F.explode(parts).alias("b"))
    return each.select(*keys, "sheet", F.col("b.name").alias("name"), crop_rect(F.col("b.bounds"), F.col("width"), F.col("height")).alias("rect"))


def cut_pages(pages: DataFrame, rows: DataFrame, keys: list[str], as_png: bool = False) -> DataFrame:
    """``keys sheet name width height gray`` (``as_png``: ``data``): the cut-outs of all pages (``keys sheet width height gray``)."""
    return cutouts.crops(pages, boxes(rows, keys), [*keys, "sheet"], as_png)
