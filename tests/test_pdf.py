"""Hand-made PDF files: inherited resources, nested trees, object streams, versions, damage."""

import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scorelake.operators import pdf_pages
from scorelake.sources import pdf_objects
from scorelake.sources.pdf_objects import pdf_nodes

IMAGE = "<< /Subtype /Image /Length 3 >>\nstream\n(<[\nendstream"
FORM = "<< /Subtype /Form /Length 0 >>\nstream\n\nendstream"


def pdf(objects, root=1, start=None, prior=b"", more=""):
    """A file of numbered bodies with a table of cross-references."""
    out, at = bytearray(prior or b"%PDF-1.5\n%\xe2\xe3\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"
    here = len(out)
    out += b"xref\n"
    for n in sorted(at):
        out += b"%d 1\n%010d 00000 n \n" % (n, at[n])
    out += f"trailer\n<< /Root {root} 0 R /Size {max(at) + 1} {more} >>\nstartxref\n{here if start is None else start}\n%%EOF\n".encode()
    return bytes(out)


def tree(*pages, resources="", **more):
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{10 + i} 0 R' for i in range(len(pages)))}] {resources} >>", 3: IMAGE, 4: FORM}
    return objects | {10 + i: f"<< /Type /Page {p} >>" for i, p in enumerate(pages)} | more


def with_streams(predictor):
    """Catalogue, tree and pages in an object stream, cross-references in a stream of differences."""
    inner = {1: "<</Type/Catalog/Pages 2 0 R>>", 2: "<</Type/Pages/Kids[5 0 R 6 0 R]/Resources 7 0 R>>", 5: "<</Type/Page>>", 6: "<</Type/Page/Resources<<>>>>", 7: "<</XObject<</A 3 0 R>>>>"}
    head, body = "", ""
    for n, x in inner.items():
        head += f"{n} {len(body)} "
        body += x + " "
    packed = zlib.compress((head + body).encode())
    out = bytearray(b"%PDF-1.5\n")
    at = {3: len(out)}
    out += b"3 0 obj\n" + IMAGE.encode() + b"\nendobj\n"
    at[4] = len(out)
    out += b"4 0 obj\n<</Type/ObjStm/N %d/First %d/Length 8 0 R/Filter/FlateDecode>>\nstream\r\n" % (len(inner), len(head)) + packed + b"\nendstream\nendobj\n"
    at[8] = len(out)
    out += b"8 0 obj\n%d\nendobj\n" % len(packed)
    at[9] = len(out)
    rows = []
    for n in range(10):
        if n in at:
            rows.append(bytes([1]) + at[n].to_bytes(2, "big") + b"\0")
        else:
            rows.append(bytes([2]) + (4).to_bytes(2, "big") + bytes([list(inner).index(n)]) if n in inner else bytes(4))
    if predictor:
        coded, above = b"", bytes(4)
        for k, r in enumerate(rows):
            rule = k % 5
            guess = []
            for i in range(4):
                left, up, corner = (r[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
                near = left + up - corner
                guess.append([0, left, up, (left + up) // 2, min((left, up, corner), key=lambda x: abs(near - x))][rule])
            coded += bytes([rule]) + bytes((a - b) & 255 for a, b in zip(r, guess))
            above = r
        parms = "/DecodeParms<</Predictor 15/Columns 4>>"
    else:
        coded, parms = b"".join(rows), ""
    packed = zlib.compress(coded)
    out += f"9 0 obj\n<</Type/XRef/Size 10/W[1 2 1]/Root 1 0 R/Filter/FlateDecode{parms}/Length {len(packed)}>>\nstream\n".encode() + packed + b"\nendstream\nendobj\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % at[9]


BASE = pdf(tree("/Resources << /XObject << /I 3 0 R >> >>"))
NEWER = pdf({10: "<< /Type /Page >>"}, prior=BASE, more=f"/Prev {BASE.rindex(b'xref', 0, BASE.rindex(b'startxref'))}")
DEEP = {1: "<< /Type /Catalog /Pages 2 0 R >>", 3: IMAGE, 50: "<< /XObject 51 0 R >>", 51: "<< /A 3 0 R >>"} | {
    2: "<< /Type /Pages /Kids 60 0 R /Resources << /XObject << >> >> >>", 60: "[20 0 R 21 0 R 22 0 R 99 0 R]",
    20: "<< /Kids [30 0 R] /Resources 50 0 R >>", 30: "<< /Kids [31 0 R 32 0 R] >>", 31: "<< /Type /Page >>", 32: "<< /Type /Page /Resources << /XObject << /F 3 0 R /G << /Subtype /Image >> >> >> >>",
    21: "<< /Type /Page >>", 22: "<< /Type /Page /Resources null /Note (un\\)\\\\(nested\\)) >> (x) /Hex <4a 4B 5> >>",
}
FILES = {
    "scan": pdf(tree("/Resources << /XObject << /I 3 0 R /F 4 0 R >> >>")),
    "vector": pdf(tree("/Resources << /XObject << /I 3 0 R >> >>", "/Resources << /Font << >> >>")),
    "form": pdf(tree("/Resources << /XObject << /F 4 0 R >> >>")),
    "inherited": pdf(tree("", "/Resources << >>", resources="/Resources << /XObject << /I 3 0 R >> >>")),
    "deep": pdf(DEEP | {22: "<< /Type /Page /Resources null /Note (un\\)\\\\\\(nested (x)) /Hex <4a 4B 5> >>"}),
    "streams": with_streams(False),
    "predicted": with_streams(True),
    "newer": NEWER,
    "moved": pdf(tree("", resources="/Resources << /XObject << /I 3 0 R >> >>"), start=7),
    "loop": pdf(tree("") | {2: "<< /Type /Pages /Kids [10 0 R 2 0 R] >>"}),
    "empty": pdf(tree()),
    "junk": b"no file of this kind",
    "nothing": b"",
    "cut": BASE[:30],
    "locked": pdf(tree(""), more="/Encrypt << /Filter /Standard >>"),
    "null": None,
}
PAGES = {
    "scan": [(True, 2, 1)],
    "vector": [(True, 1, 1), (True, 0, 0)],
    "form": [(True, 1, 0)],
    "inherited": [(True, 1, 1), (False, 0, 0)],
    "deep": [(True, 1, 1), (True, 2, 2), (True, 0, 0), (True, 0, 0)],
    "streams": [(True, 1, 1), (False, 0, 0)],
    "predicted": [(True, 1, 1), (False, 0, 0)],
    "newer": [(False, 0, 0)],
    "moved": [(True, 1, 1)],
    "loop": [(False, 0, 0)],
}


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in FILES.items()], "file string, content binary").repartition(3)
    nodes = pdf_nodes(files, ["file"]).cache()
    return files, nodes, pdf_pages.pages(nodes, ["file"])


def test_pages(tables):
    found = {}
    for r in sorted(tables[2].collect(), key=lambda r: (r["file"], r["page"])):
        assert r["page"] == len(found.setdefault(r["file"], [])) + 1
        found[r["file"]].append((r["has_resources"], r["n_objects"], r["n_images"]))
    assert found == PAGES


def test_vector_files(tables):
    files, _, pages = tables
    got = {r["file"]: r["is_vector"] for r in pdf_pages.vector_files(pages, files, ["file"]).collect()}
    assert got == {k: any(not n for _, _, n in PAGES.get(k, [])) for k in FILES}


def test_problems(tables):
    got = {(r["file"], r["object"]): r["error"] for r in pdf_pages.problems(tables[1], ["file"]).collect()}
    assert got == {("junk", None): "not a PDF", ("nothing", None): "not a PDF", ("null", None): "not a PDF", ("cut", None): "no catalogue", ("locked", None): "encrypted", ("loop", 2): "contains itself"}


def test_page_range(tables):
    _, _, pages = tables
    deep = pages.where("file = 'deep'")
    assert sorted(r["page"] for r in pdf_pages.page_range(deep, ["file"], F.lit(2), F.lit(3)).collect()) == [2, 3]
    for first in (2, 5):
        with pytest.raises(PySparkException, match="last page"):
            pdf_pages.page_range(deep, ["file"], F.lit(first), F.lit(5)).collect()


def test_values():
    text = b"<< /A#20b [1 -2 .5 true null (a(b)\\)c) <4a4b5> /n 12 0 R 3 4 % no\n ] /D<</E/F>>>>"
    assert pdf_objects.Reader(text).value(0)[0] == {"/A b": [1, -2, 0.5, True, None, b"a(b)\\)c", b"JKP", "/n", ("ref", 12), 3, 4], "/D": {"/E": "/F"}}
    for bad in (b"<< /A", b"[1", b"(a", b"<< 1 2 >>", b"foo", b"[" * 5000):
        with pytest.raises(pdf_objects.Broken):
            pdf_objects.Reader(bad).value(0)


def test_no_files(spark):
    files = spark.createDataFrame([], "file string, content binary")
    assert pdf_pages.pages(pdf_nodes(files, ["file"]), ["file"]).count() == 0


def odd_files():
    """Trees that loop, share, lack or misplace what the walk reads."""
    yield tree("/Resources 3 0 R", "", **{}) | {2: "<< /Type /Pages /Kids 5 0 R /Resources << /XObject 6 0 R >> >>", 5: "[10 0 R 11 0 R 99 0 R 2 0 R 10 0 R (x) 12 0 R]", 6: "<< /A 3 0 R /B 4 0 R /C null /D 7 >>", 12: "<< /Resources << /XObject << /I << /Subtype /Image >> >> >> >>"}
    yield tree("/Kids [11 0 R]", "/Resources null", "/Resources << /Font 1 >>", "/Resources [1]", resources="/Resources << /XObject << /A 3 0 R >> >>")
    yield tree("(a endobj b) /B", "/Resources << /XObject << /A (endobj \n) /B 3 0 R >> >>", "% endobj \n /Resources << /XObject << /A 3 0 R >> >>")
    yield {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [3 0 R 5 0 R] /Resources 5 0 R >>", 3: "<< /Kids [4 0 R 2 0 R] >>", 4: "<< /Type /Page /Resources 6 0 R >>", 5: "<< /Type /Page >>", 6: "5 0 R"}
    yield {1: "<< /Type /Catalog /Pages << /Kids [3 0 R] >> >>", 3: "<< /Type /Page >>"}
    yield {1: "<< /Type /Catalog >>"}


def test_pages_read_in_one_pass(spark, tables):
    """As by the node table; equal texts of objects are parsed once, and nothing is dealt out or joined."""
    files, _, _ = tables
    rows = [(r["file"], r["content"]) for r in files.collect()] + [(f"odd {k}", pdf(x)) for k, x in enumerate(odd_files())] + [(f"lost {k}", pdf(x, start=3)) for k, x in enumerate(odd_files())]
    files = spark.createDataFrame(rows, files.select("file", "content").schema)
    nodes = pdf_nodes(files, ["file"]).cache()
    pages = pdf_pages.pages(nodes, ["file"])
    want = pdf_pages.vector_files(pages, files, ["file"]).join(nodes.where("object IS NULL").select("file", "error"), "file", "left").join(pages, "file", "left")
    made = pdf_pages.read_pages(files, ["file"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    of = lambda df: sorted(map(repr, df.select("file", "is_vector", "error", "page", "object", "has_resources", "n_objects", "n_images").collect()))
    assert of(made) == of(want)


def test_equal_objects_are_parsed_once():
    known = {}
    pdf_objects.File(pdf(tree("", "/A 1")), known).object(10)
    before = dict(known)
    f = pdf_objects.File(pdf(tree("", "")), known)
    assert f.object(10) is before[b"\n<< /Type /Page  >>\n"] and f.object(11) is f.object(10)
