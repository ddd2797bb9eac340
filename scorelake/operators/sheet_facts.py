"""Recognition archives without node tables: a sheet's facts where it is parsed, a layout from those of its archive.

A document becomes one row of what its layout needs; only these rows are brought together by archive. Results
are those of ``operators.recognition``, whose node tables stay for everything else that is asked of documents.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.geometry import DEFAULT_SPACE, PADDING_SPACES

_BLANK = " \t\n\x0b\f\r"
_INT = re.compile(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*\Z")
_DOUBLE = re.compile(r"[\x00-\x20]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[dDfF]?[\x00-\x20]*\Z")
#: Rows handed on at a time.
BATCH = 20_000
#: Columns after the keys: a problem's or a system's.
FIELDS = "name string, reason string, detail string, fatal boolean, sheet long, system long, x long, y long, width long, height long, first_measure long, last_measure long"


def _int(text: str | None) -> int | None:
    m = _INT.match(text) if text else None
    n = int(m[1]) if m else None
    return n if n is not None and -(1 << 31) <= n < 1 << 31 else None


def _double(text: str | None) -> float | None:
    m = _DOUBLE.match(text) if text else None
    return float(m[1]) if m else None


def _least(xs):
    return min((x for x in xs if x is not None), default=None)


def _most(xs):
    return max((x for x in xs if x is not None), default=None)


def _system(el) -> list:
    """The extents of the staves of a system's first part and of its symbols, and how many stacks it has."""
    part, sig = el.find("part"), el.find("sig")
    left, right, top, bottom = [], [], [], []
    for staff in part.findall("staff") if part is not None else ():
        left.append(_int(staff.get("left")))
        right.append(_int(staff.get("right")))
        if (lines := staff.find("lines")) is not None and (each := lines.findall("line")):
            for into, line in ((top, each[0]), (bottom, each[-1])):
                point = line.find("point")
                into.append(None if point is None else _double(point.get("y")))
    glyphs = []
    if sig is not None and (inters := sig.find("inters")) is not None:
        for symbol in inters:
            if (b := symbol.find("bounds")) is not None:
                box = [_int(b.get(c)) for c in "xywh"]
                if None not in box:
                    glyphs.append((box[0], box[1], box[0] + box[2], box[1] + box[3]))
    whole = lambda x: 0 if x is None else round(x)
    staves = [_least(left) or 0, whole(_least(top)), _most(right) or 0, whole(_most(bottom))]
    around = [f(g[k] for g in glyphs) for k, f in enumerate((min, min, max, max))] if glyphs else None
    return [staves, around, len(el.findall("stack"))]


def facts(xml: str, is_book: bool):
    """What a layout needs of a document; a text where it isn't XML."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return str(e)
    if is_book:
        listed = []
        for sheet in root.findall("sheet") if root.tag == "book" else ():
            page = sheet.find("page")
            listed.append([_int(sheet.get("number")), (_int(page.get("delta-measure-id")) if page is not None else None) or 0])
        return listed
    own = root.tag == "sheet"
    picture, space, page = (root.find(p) if own else None for p in ("picture", "scale/interline", "page"))
    size = [None, None] if picture is None else [_int(picture.get("width")), _int(picture.get("height"))]
    space = _double(space.get("main")) if space is not None else None
    return [size, round((DEFAULT_SPACE if space is None else space) * PADDING_SPACES), [_system(s) for s in page.findall("system")] if page is not None else []]


def _file(sheet: int | None) -> str:
    return "book.xml" if sheet is None else f"sheet#{sheet}/sheet#{sheet}.xml"


def problems(rows: list[dict]) -> list[tuple]:
    """``name reason detail`` of an archive's documents, as ``recognition.problems`` tells them."""
    told = [(r["name"], "archive" if r["name"] is None else "member", r["error"]) for r in rows if r["error"] is not None]
    told += [(_file(r["sheet"]), "not XML", r["facts"]) for r in rows if isinstance(r["facts"], str)]
    told += [(r["name"], "empty", None) for r in rows if r["error"] is None and r["blank"]]
    if all(r["name"] is not None for r in rows) and all(r["sheet"] is not None for r in rows):
        told.append((None, "no book", None))
    read = [r for r in rows if isinstance(r["facts"], list)]
    books = [r["facts"] for r in read if r["sheet"] is None]
    listed = Counter(sheet for b in books for sheet, _ in b)
    have = {r["sheet"] for r in rows if r["sheet"] is not None}
    told += [(_file(s), "missing sheet", None) for s in listed if s not in have]
    told += [(_file(s), "sheet twice", None) for s, n in listed.items() if n > 1]
    told += [(_file(s), "no size", None) for s in dict.fromkeys(r["sheet"] for r in read if r["sheet"] is not None and None in r["facts"][0]) if s in listed]
    return told + [(_file(s), "unlisted", None) for s in sorted(have) if books and s not in listed]


def systems(rows: list[dict]):
    """``sheet system x y width height first_measure last_measure`` of an archive without a fatal problem."""
    sheets = {r["sheet"]: r["facts"] for r in rows if r["sheet"] is not None and isinstance(r["facts"], list)}
    offset, before = {}, 0
    for r in rows:
        if r["sheet"] is None and isinstance(r["facts"], list):
            for sheet, declared in r["facts"]:
                offset[sheet] = before
                before += declared
    number = 0
    for sheet in sorted(offset):
        if sheet not in sheets:
            continue
        (_, height), padding, each = sheets[sheet]
        at = offset[sheet]
        for (left, top, right, bottom), around, stacks in each:
            number += 1
            y, bottom = max(0, top - padding), min(height - 1, bottom + padding)
            if around:
                left, y, right, bottom = min(left, around[0]), min(y, around[1]), max(right, around[2]), max(bottom, around[3])
            yield sheet, number, left, y, right - left, bottom - y, *((at + 1, at + stacks) if stacks else (None, None))
            at += stacks


def read(documents: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and :data:`FIELDS` of ``recognition.texts``: the systems of each archive's layout, and what is wrong with it."""
    n, own = len(keys), "".join(f"`{k}` {documents.schema[k].dataType.simpleString()}, " for k in keys)

    def parsed(batches):
        for batch in batches:
            blank, found = [], []
            for i in range(batch.num_rows):
                sheet, xml = (batch.column(n + k)[i].as_py() for k in (1, 2))
                blank.append(not (xml or "").strip(_BLANK))
                found.append(json.dumps(facts(xml, sheet is None)) if (xml or "").strip() else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in (*range(n + 2), n + 3)), pa.array(blank, pa.bool_()), pa.array(found, pa.string())], names=[*keys, "name", "sheet", "error", "blank", "facts"])

    def told(batches):
        kinds = {f.split()[0]: {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}[f.split()[1]] for f in FIELDS.split(", ")}

        def made(batch, at, rows):
            return pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(at, pa.int32())) for j in range(n)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True))], names=[*keys, *kinds])

        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                own = [r | {"facts": json.loads(r["facts"]) if r["facts"] else None} for r in batch.column(n)[i].as_py()]
                wrong = problems(own)
                got = [(*p, p[1] != "unlisted", *[None] * 8) for p in wrong]
                if all(reason == "unlisted" for _, reason, _ in wrong):
                    got += [(*[None] * 4, *s) for s in systems(own)]
                at += [i] * len(got)
                rows += got
                if len(rows) >= BATCH:
                    yield made(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield made(batch, at, rows)

    each = documents.select(*keys, "name", "sheet", "xml", "error").mapInArrow(parsed, f"{own}name string, sheet int, error string, blank boolean, facts string")
    gathered = each.groupBy(*keys).agg(F.collect_list(F.struct("name", "sheet", "error", "blank", "facts")).alias("_rows"))
    return gathered.mapInArrow(told, own + FIELDS)
