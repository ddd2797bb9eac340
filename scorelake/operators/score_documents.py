"""Score documents cleaned and cut up one at a time, in the task that parses them.

A score is one row, so its tree is in memory anyway; making it a node table first would move a row for
each element. Results are those of the node tables of ``operators.score_xml``, which stay for joins.
"""

from __future__ import annotations

import re
from math import gcd
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import DOCTYPE
from scorelake.operators.score_xml import BY_TAG, CARRIED, COORDINATES, OF_SCORE_PART, PLACED, STYLES, TOP_LEVEL

_GONE = {tag: frozenset(COORDINATES + STYLES + names) for tag, names in (BY_TAG | {t: ["placement"] for t in PLACED}).items()}
_EVERYWHERE = frozenset(COORDINATES + STYLES)
_BLANK = " \t\n\x0b\f\r"
_LONG = re.compile(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*\Z")
_SPECIAL_VALUE = re.compile('[&<>"\n\t]')
TOP = '<?xml version="1.0" encoding="UTF-8"?>'
#: Characters of results handed on at a time.
BATCH = 1 << 22


def _number(text: str | None, bits: int = 64) -> int | None:
    """As ``try_cast`` reads a whole number."""
    m = _LONG.match(text) if text else None
    if m is None:
        return None
    n = int(m[1])
    return n if -(1 << (bits - 1)) <= n < 1 << (bits - 1) else None


def _safe(text: str) -> str:
    if "&" in text or "<" in text or ">" in text:
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text


def _value(text: str) -> str:
    if _SPECIAL_VALUE.search(text) is None:
        return text
    return _safe(text).replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#09;")


def _shown(text: str | None) -> str:
    return _safe(text) if text and text.strip(_BLANK) else ""


def _plain(el) -> str:
    return "".join([f' {k}="{_value(v)}"' for k, v in el.attrib.items()])


def _stripped(el) -> str:
    gone = _GONE.get(el.tag, _EVERYWHERE)
    return "".join([f' {k}="{_value(v)}"' for k, v in el.attrib.items() if k not in gone])


def written(el, depth: int, out: list[str], attributes=_plain) -> None:
    """Appends an element's indented lines, without recursion."""
    add, todo, kids, pad, end = out.append, [], iter((el,)), "  " * depth, ""
    while True:
        for el in kids:
            tag, text, tail = el.tag, el.text, el.tail
            start = f"{pad}<{tag}{attributes(el)}" if el.attrib else f"{pad}<{tag}"
            text = _shown(text) if text else ""
            tail = _shown(tail) if tail else ""
            if len(el):
                add(f"{start}>{text}")
                todo.append((kids, pad, end))
                kids, end, pad = iter(el), f"{pad}</{tag}>{tail}", pad + "  "
                break
            add(f"{start}>{text}</{tag}>{tail}" if text else f"{start} />{tail}")
        else:
            if not todo:
                return
            add(end)
            kids, pad, end = todo.pop()


def measures_of(part) -> list:
    return [m for m in part if m.tag == "measure"]


def parts_of(root) -> list[tuple]:
    """The parts that have measures, and these."""
    return [(p, m) for p in root if p.tag == "part" and (m := measures_of(p))]


def _span(measure) -> int | None:
    """The furthest position that a measure's notes reach, null without notes, backups and forwards."""
    at = low = most = 0
    seen = False
    for e in measure:
        kind = e.tag
        if kind not in ("note", "backup", "forward"):
            continue
        seen, duration, chord = True, None, False
        for c in e:
            if c.tag == "duration":
                if duration is None:
                    duration = c.text or ""
            elif c.tag == "chord":
                chord = True
        d = _number(duration) or 0
        at += -d if kind == "backup" else 0 if kind == "note" and chord else d
        low = min(low, at)
        most = max(most, at - low)
    return most if seen else None


def _stated(measure) -> tuple[int | None, int | None, int | None]:
    """Divisions, beats and beat type: of each the first in a measure."""
    found: dict[str, str | None] = {}
    for a in measure:
        if a.tag == "attributes":
            for e in a:
                if e.tag == "divisions":
                    found.setdefault("divisions", e.text)
                elif e.tag == "time":
                    for b in e:
                        if b.tag in ("beats", "beat-type"):
                            found.setdefault(b.tag, b.text)
    return tuple(_number(found.get(k)) for k in ("divisions", "beats", "beat-type"))


def signatures(measures: list) -> list[tuple[int | None, int | None] | None]:
    """The signature in force in each measure, as ``timing.effective_signatures`` has it."""
    divisions, sig, past, out = 1, None, None, []
    for m in measures:
        span, (div, beats, kind) = _span(m), _stated(m)
        divisions = divisions if div is None else div
        own = (span, divisions) if span else None
        hint = (beats * 4, kind) if beats is not None and kind is not None and kind > 0 else None
        same = lambda x: x[0] * own[1] == x[1] * own[0]  # noqa: B023, E731
        if own is None:
            sig = (beats, kind) if hint else sig
        elif hint is not None and same(hint):
            sig = (beats, kind)
        elif hint is not None or past is None or not same(past):
            g = gcd(*own)
            sig = (own[0] // g, own[1] // g * 4) if own[1] > 0 else (None, None)
        past = own or hint or past
        out.append(sig)
    return out


def _element(tag: str, text: str | None = None, *children):
    el = ElementTree.Element(tag)
    el.text = text
    el.extend(children)
    return el


def _place(measure) -> tuple:
    """A measure's first attributes (null without) and the index among their children at which new ones go: after the divisions."""
    own = next((a for a in measure if a.tag == "attributes"), None)
    return own, 0 if own is None else next((i + 1 for i, e in enumerate(own) if e.tag == "divisions"), 0)


def _drop(el, tags) -> None:
    if any(x.tag in tags for x in el):
        el[:] = [x for x in el if x.tag not in tags]


def cleaned(root) -> str:
    """A cleaned score's lines (its tree is changed): page matter and styles gone, signatures recomputed from the first part's lengths."""
    parts = parts_of(root)
    sigs = signatures(parts[0][1]) if parts else []
    _drop(root, TOP_LEVEL)
    for top in root:
        for inner in top:
            if inner.tag == "score-part":
                _drop(inner, OF_SCORE_PART)
            for x in inner:
                if x.tag == "attributes":
                    _drop(x, ("time",))
    for m in root.iter("measure"):
        _drop(m, ("print",))
    for _, measures in parts:
        before = None
        for i, m in enumerate(measures):
            now = sigs[min(i, len(sigs) - 1)] or (None, None)
            if now != before and now[0] is not None:
                time = _element("time", None, _element("beats", str(now[0])), _element("beat-type", None if now[1] is None else str(now[1])))
                own, at = _place(m)
                if own is None:
                    m.insert(0, _element("attributes", None, time))
                else:
                    own.insert(at, time)
            before = now
    out: list[str] = []
    written(root, 0, out, _stripped)
    return "\n".join(out)


def _rows(batches, n_keys: int, names: list[str], kinds: list[pa.DataType], made):
    """Batches of the keys and what ``made`` yields for the rest of a row; a document that is blank or no XML has nothing."""
    for batch in batches:
        at, rows, size = [], [], 0

        def out():
            columns = [batch.column(j).take(pa.array(at, pa.int32())) for j in range(n_keys)]  # noqa: B023
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], names=names)  # noqa: B023

        for i in range(batch.num_rows):
            given = [batch.column(j)[i].as_py() for j in range(n_keys, batch.num_columns)]
            if not (given[0] or "").strip():
                continue
            try:
                root = ElementTree.fromstring(given[0])
            except ElementTree.ParseError:
                continue
            for row in made(root, *given):
                at.append(i)
                rows.append(row)
                size += len(row[-1])
                if size >= BATCH:
                    yield out()
                    at, rows, size = [], [], 0
        if rows:
            yield out()


def _fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def clean(documents: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """``keys xml``: cleaned documents with declaration and, where there was one, document type."""
    names, n, kind = [*keys, xml], len(keys), re.compile(DOCTYPE)

    def made(root, text):
        m = kind.search(text)
        yield ("\n".join([TOP, *([m[0]] if m else []), cleaned(root)]),)

    return documents.select(*keys, xml).mapInArrow(lambda batches: _rows(batches, n, names, [pa.string()], made), f"{_fields(documents, keys)}`{xml}` string")


def _in_force(found: dict[int, dict], n: int) -> dict[int, list]:
    """By system (or measure) the elements that it starts with, in the order in which their keys were first seen.

    ``found``: by system and key, the place of the first of its elements and the last one.
    """
    held: dict[tuple, tuple] = {}
    out = {}
    for s in range(1, n + 1):
        if held:
            out[s] = [(key, el) for key, (_, el) in sorted(held.items(), key=lambda x: x[1][0])]
        for key, (first, el) in found.get(s, {}).items():
            held[key] = (held[key][0] if key in held else first, el)
    return out


def cut(root, systems: list[dict], carry_to: str):
    """``kind global_id xml`` for each system and each measure of it: see :func:`snippets`."""
    own = parts_of(root)
    if not own:
        return
    by_number = []
    for _, measures in own:
        by_number.append({n: m for m in measures if (n := _number(m.get("number"), 32)) is not None})
    least = lambda x: (x is not None, x)
    ordered = sorted(systems, key=lambda s: (least(s["first"]), least(s["last"]), least(s["system_id"])))
    wanted = {}
    for at, s in enumerate(ordered, 1):
        if s["first"] is not None and s["last"] is not None:
            wanted[at] = sorted(n for n in by_number[0] if s["first"] <= n <= s["last"])

    carried: dict[tuple, list] = {}  # by system and part, and by part and measure's place
    rows: dict[tuple, dict] = {}  # by kind, system and number: by part the measures
    for p, (part, _) in enumerate(own):
        of_system: dict[int, dict] = {}
        of_measure: dict[int, dict] = {}
        k = seen = 0
        for at, numbers in wanted.items():
            for n in numbers:
                m = by_number[p].get(n)
                if m is None:
                    continue
                k += 1
                rows.setdefault(("system", at, ordered[at - 1]["system_id"]), {}).setdefault(part, []).append((m, at, ("s", p, at)))
                rows.setdefault(("measure", at, n), {})[part] = [(m, at, ("s", p, at) if carry_to != "measure" else ("m", p, k))]
                for a in m:
                    for e in a if a.tag == "attributes" else ():
                        if e.tag in CARRIED:
                            key, seen = (e.tag, e.get("number")), seen + 1
                            for into in (of_system.setdefault(at, {}), of_measure.setdefault(k, {})):
                                into[key] = (into[key][0] if key in into else seen, e)
        carried |= {("s", p, s): v for s, v in _in_force(of_system, len(ordered)).items()}
        if carry_to == "measure":
            carried |= {("m", p, s): v for s, v in _in_force(of_measure, k).items()}

    body: dict[tuple, str] = {}

    def lines(m, start) -> str:
        """A measure's lines, with what is in force at its start and it doesn't set itself."""
        attributes, at = _place(m)
        have = {(e.tag, e.get("number")) for e in attributes if e.tag in CARRIED} if attributes is not None else ()
        put = [el for key, el in carried.get(start, ()) if key not in have]
        if (m, start if put else None) in body:
            return body[m, start if put else None]

        if put and attributes is None:
            m.insert(0, _element("attributes", None, *put))
        elif put:
            attributes[at:at] = put
        written(m, 2, out := [])
        if put and attributes is None:
            del m[0]
        elif put:
            del attributes[at : at + len(put)]
        body[m, start if put else None] = text = "\n".join(out)
        return text

    only = lambda el, name: f' {name}="{_value(el.attrib[name])}"' if name in el.attrib else ""
    frame: list = []  # texts, and parts between them
    for c in root:
        if c.tag == "part-list":
            written(c, 1, lines_ := [])
            frame.append("\n".join(lines_))
        elif c.tag == "part":
            frame.append(c)
    head, ends = f"<{root.tag}{only(root, 'version')}>{_shown(root.text)}", f"</{root.tag}>"
    latest = {(kind, global_id): (kind, at, global_id) for kind, at, global_id in sorted(rows, key=lambda r: r[1])}
    for (kind, global_id), row in latest.items():
        out = [TOP, head]
        for c in frame:
            if isinstance(c, str):
                out.append(c)
                continue
            found = rows[row].get(c)
            start, text = f"  <part{only(c, 'id')}", _shown(c.text)
            if found:
                out.append(f"{start}>{text}")
                out += [lines(m, first if i == 0 else None) for i, (m, _, first) in enumerate(found)]
                out.append(f"  </part>{_shown(c.tail)}")
            else:
                out.append(f"{start}>{text}</part>{_shown(c.tail)}" if text else f"{start} />{_shown(c.tail)}")
        yield kind, global_id, "\n".join([*out, ends])


def snippets(documents: DataFrame, systems: DataFrame, keys: list[str], carry_to: str = "system", xml: str = "xml") -> DataFrame:
    """``keys kind global_id xml``: a document per system and per measure of it, as ``score_xml.snippets`` makes them of nodes.

    ``systems``: ``keys system_id first last``. Where systems share a measure, its own snippet is that of the later system.
    """
    given = systems.groupBy(*keys).agg(F.collect_list(F.struct("system_id", "first", "last")).alias("_systems"))
    n, wide = len(keys), any(systems.schema[c].dataType.simpleString() != "int" for c in ("system_id", "first", "last"))
    names, kinds = [*keys, "kind", "global_id", xml], [pa.string(), pa.int64() if wide else pa.int32(), pa.string()]

    def made(root, _, own):
        yield from cut(root, own, carry_to)

    both = documents.select(*keys, xml).join(given, keys)
    return both.select(*keys, xml, "_systems").mapInArrow(lambda batches: _rows(batches, n, names, kinds, made), f"{_fields(documents, keys)}kind string, global_id {'bigint' if wide else 'int'}, `{xml}` string")
