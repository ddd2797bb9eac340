"""Recognition archives, made in memory, to layouts, JSON and cut-outs."""

import io
import json
import zipfile

import numpy as np

from scorelake.operators import recognition
from scorelake.sources.archives import members

BOOK = '<book software-version="5.3"><sheet number="2"><page delta-measure-id="5"/></sheet><sheet number="1"><page/></sheet></book>'
SHEET_2 = """<sheet><scale><interline main="10"/></scale><picture width="400" height="300"/><page>
<system id="1"><stack id="1" left="100" right="180"/><stack id="2" left="20" right="100"/>
<part id="1"><staff left="20" right="180"><lines><line><point x="1" y="100.5"/><point x="2" y="9"/></line><line><point x="1" y="140"/></line></lines></staff></part>
<part id="2"><staff left="0" right="390"><lines><line><point x="1" y="1"/></line></lines></staff></part>
<sig><inters><head><bounds x="10" y="120" w="5" h="100"/></head><bad><bounds x="a" y="1" w="1" h="1"/></bad><none/></inters></sig></system>
<system id="2"><stack id="3" left="30" right="60"/></system></page><page><system id="9"><stack id="9" left="1" right="2"/></system></page></sheet>"""
SHEET_1 = '<sheet><picture width="100" height="80"/><page><system id="1"><stack id="1" left="5" right="50"/></system></page></sheet>'


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def rows(spark):
    whole = archive(**{"book.xml": BOOK, "sheet#1/sheet#1.xml": SHEET_1, "sheet#2/sheet#2.xml": SHEET_2, "sheet#2/picture.png": b"x", "sheet#3/sheet#2.xml": "<sheet/>"})
    return spark.createDataFrame([(1, whole), (2, bytearray(b"no archive")), (3, None)], "id int, content binary")


def test_members(spark):
    got = members(rows(spark), ["id"], only=r"book\.xml").collect()
    assert [(r["id"], r["name"]) for r in got if r["error"] is None] == [(1, "book.xml")]
    assert [r["id"] for r in got if r["error"]] == [2]


def test_layout_json_and_cut_outs(spark):
    found = recognition.layouts(rows(spark), ["id"])
    document = recognition.to_json(found, ["id"])
    (told,) = document.collect()
    sheets = {s["sheet"]: s for s in json.loads(told["json"])["sheets"]}
    assert (sheets[2]["width"], sheets[2]["height"], sheets[1]["width"]) == (400, 300, 100)
    one, two = sheets[2]["systems"]
    # staves 20..180 by 100..140 (half to even), padded by 45, and the symbol at 10..15 by 120..220
    assert one["bounds"] == {"x": 10, "y": 55, "width": 170, "height": 165}
    assert [(m["local_id"], m["global_id"], m["bounds"]["x"], m["bounds"]["width"]) for m in one["measures"]] == [(1, 1, 20, 80), (2, 2, 100, 80)]
    assert one["measure_range"] == [1, 2] and [m["global_id"] for m in two["measures"]] == [3]
    # the book has sheet 2 first and declares five measures for it
    assert sheets[1]["systems"][0]["measures"][0]["global_id"] == 6
    back = recognition.from_json(document, ["id"])
    assert back.collect() == found.collect()
    assert recognition.from_json(spark.createDataFrame([(1, "{")], "id int, json string"), ["id"]).collect()[0]["sheets"] is None
    page = np.arange(300 * 400, dtype=np.int64).reshape(300, 400) % 251
    pages = spark.createDataFrame([(1, 2, 400, 300, bytearray(page.astype(np.uint8).tobytes()))], "id int, sheet int, width int, height int, gray binary")
    cut = {r["name"]: r for r in recognition.cut_pages(pages, found, ["id"]).collect()}
    assert sorted(cut) == ["measures/measure_0001.png", "measures/measure_0002.png", "measures/measure_0003.png", "systems/system_0002.png", "systems/system_0003.png"]
    r = cut["measures/measure_0002.png"]
    assert (np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"]) == page[47:228, 92:188]).all()
    assert recognition.book_version(recognition.documents(rows(spark), ["id"]), ["id"]).collect()[0]["version"] == "5.3"


SIZED = '<sheet><picture width="9" height="9"/><page><system id="1"><stack id="1" left="1" right="2"/></system></page></sheet>'
LISTS = lambda *n: "<book>" + "".join(f'<sheet number="{k}"><page delta-measure-id="1"/></sheet>' for k in n) + "</book>"
ODD = {
    "good": ({"book.xml": LISTS(1), "sheet#1/sheet#1.xml": SIZED}, set()),
    "lost": ({"book.xml": LISTS(1, 2), "sheet#1/sheet#1.xml": SIZED}, {("sheet#2/sheet#2.xml", "missing sheet")}),
    "more": ({"book.xml": LISTS(1), "sheet#1/sheet#1.xml": SIZED, "sheet#7/sheet#7.xml": "<sheet/>"}, {("sheet#7/sheet#7.xml", "unlisted")}),
    "twice": ({"book.xml": LISTS(1, 1), "sheet#1/sheet#1.xml": SIZED}, {("sheet#1/sheet#1.xml", "sheet twice")}),
    "broken": ({"book.xml": LISTS(1), "sheet#1/sheet#1.xml": SIZED[:-3]}, {("sheet#1/sheet#1.xml", "not XML")}),
    "blank": ({"book.xml": LISTS(1), "sheet#1/sheet#1.xml": " \n"}, {("sheet#1/sheet#1.xml", "empty")}),
    "no book": ({"sheet#1/sheet#1.xml": SIZED}, {(None, "no book")}),
    "bad book": ({"book.xml": "<book>", "sheet#1/sheet#1.xml": SIZED}, {("book.xml", "not XML")}),
    "no size": ({"book.xml": LISTS(1), "sheet#1/sheet#1.xml": SIZED.replace('width="9"', 'width="x"')}, {("sheet#1/sheet#1.xml", "no size")}),
    "no sheets": ({"book.xml": "<book/>"}, set()),
    "nothing": ({}, {(None, "archive")}),
    "other": ({"readme.txt": "x"}, {(None, "archive")}),
}


def test_every_archive_has_a_layout_or_a_reason(spark):
    data = [(k, archive(**files)) for k, (files, _) in ODD.items()]
    flawed = bytearray(archive(**{"book.xml": LISTS(1), "sheet#1/sheet#1.xml": SIZED}))
    at = flawed.index(b"<sheet><picture")
    flawed[at : at + 4] = b"\0\0\0\0"  # its checksum tells
    df = spark.createDataFrame([*data, ("flawed", flawed), ("junk", bytearray(b"x")), ("null", None)], "id string, content binary").repartition(3)
    layouts, told = recognition.read(df, ["id"])
    got = {}
    for r in told.collect():
        assert r["fatal"] == (r["reason"] != "unlisted") and r["reason"] in recognition.REASONS
        got.setdefault(r["id"], set()).add((r["name"], r["reason"]))
    want = {k: w for k, (_, w) in ODD.items() if w} | {"junk": {(None, "archive")}, "null": {(None, "archive")}, "flawed": {("sheet#1/sheet#1.xml", "member")}}
    assert got == want
    sheets = {r["id"]: len(r["sheets"]) for r in layouts.collect()}
    assert sheets == {"good": 1, "more": 1, "no sheets": 0}
    assert set(sheets) | {k for k, w in got.items() if {r for _, r in w} != {"unlisted"}} == {*ODD, "flawed", "junk", "null"}
    empty = recognition.read(df.limit(0), ["id"])
    assert empty[0].count() == empty[1].count() == 0
