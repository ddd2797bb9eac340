"""Timing, carrying and slicing against plain folds; scores as XML; documents."""

import random
from fractions import Fraction
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from scorelake.operators import artifacts, carry, engraving, header, raster, reconcile, score_xml, slicing, timing
from scorelake.sources.xml_nodes import serialize, xml_nodes

from .conftest import rows_of


def random_events(seed, parts=6, measures=8):
    rng = random.Random(seed)
    return [
        (p, m, i, rng.choice(["note", "note", "backup", "forward", "other"]), rng.choice([None, "", "x", "0", "1", "2", "5"]), rng.random() < 0.2)
        for p in range(parts) for m in range(measures) for i in range(rng.randrange(7))
    ]


def number(text):
    return int(text) if text and text.isdigit() else 0


def span_of(events):
    at = most = 0
    for _, _, _, kind, duration, chord in events:
        if kind == "forward" or kind == "note" and not chord:
            at += number(duration)
            most = max(most, at)
        elif kind == "backup":
            at = max(0, at - number(duration))
    return most


@pytest.fixture(scope="module")
def spans(spark):
    rows = random_events(1)
    df = spark.createDataFrame(rows, "part int, measure int, ord int, kind string, duration string, has_chord boolean")
    return rows, timing.measure_span(df, ["part", "measure"], ["ord"])


def test_spans_match_a_fold(spans):
    rows, got = spans
    want = {}
    for r in rows:
        want.setdefault(r[:2], []).append(r)
    assert {(r["part"], r["measure"]): r["span"] for r in rows_of(got)} == {k: span_of(sorted(v, key=lambda r: r[2])) for k, v in want.items()}
    assert sum(r["n_bad"] for r in rows_of(got)) == sum(r[4] == "x" for r in rows)


def signatures(measures):
    divisions, sig, out = 1, None, []
    for span, div, beats, kind in measures:
        divisions = div or divisions
        if beats is not None and kind is not None:
            sig = (beats, kind)
        if span:
            own = Fraction(span, divisions)
            if sig is None or own != Fraction(sig[0] * 4, sig[1]):
                sig = (own.numerator, 4 * own.denominator)
        out.append(sig)
    return out


def test_signatures_match_a_fold(spark):
    rng = random.Random(3)
    parts = [
        [(rng.choice([0, 0, 1, 2, 3, 6, None]), rng.choice([None, None, 2, 3]), rng.choice([None, None, 6, 3]), rng.choice([8, 4, 4, None])) for _ in range(12)]
        for _ in range(40)
    ]
    rows = [(p, i, *m) for p, ms in enumerate(parts) for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "part int, at int, span long, divisions long, beats long, beat_type long")
    eff = timing.effective_signatures(df, ["part"], ["at"])
    got = {(r["part"], r["at"]): r["sig_beats"] and (r["sig_beats"], r["sig_beat_type"]) for r in rows_of(eff)}
    want = {(p, i): s for p, ms in enumerate(parts) for i, s in enumerate(signatures(ms))}
    assert got == want
    changed = {(r["part"], r["at"]) for r in rows_of(timing.changes(eff, ["part"], ["at"]))}
    assert changed == {(p, i) for (p, i), s in want.items() if s and s != want.get((p, i - 1))}


def test_pickup_bar_never_returns_to_the_hint(spark):
    df = spark.createDataFrame([(1, 1, 2, 6, 8), (2, 6, None, None, None), (3, 6, None, None, None)], "at int, span long, divisions long, beats long, beat_type long")
    got = rows_of(timing.effective_signatures(df.withColumn("part", F.lit(1)), ["part"], ["at"]))
    assert [(r["sig_beats"], r["sig_beat_type"]) for r in sorted(got, key=lambda r: r["at"])] == [(1, 8), (3, 4), (3, 4)]


def test_in_force_matches_a_fold(spark):
    rng = random.Random(5)
    rows = [(p, rng.randrange(1, 6), i, rng.choice("kc"), rng.choice([None, "1", "2"])) for p in range(10) for i in range(12)]
    rows = [(p, s, s * 100 + i, t, n) for p, s, i, t, n in rows]
    df = spark.createDataFrame(rows, "part int, system int, ord int, tag string, number string").withColumn("n", F.lit(6))
    got = {(r["part"], r["system"], r["tag"], r["number"]): (r["ord"], r["key_order"]) for r in rows_of(carry.in_force(df, ["part"], ["tag", "number"], "system", ["ord"], "ord", "n"))}
    want = {}
    for p in range(10):
        for s in range(1, 7):
            held = {}
            for r in sorted(x for x in rows if x[0] == p and x[1] < s):
                held.setdefault(r[3:], None)
                held[r[3:]] = r[2]
            seen = sorted(held, key=lambda k: min(x[2] for x in rows if x[0] == p and x[3:] == k))
            want |= {(p, s, *k): (held[k], seen.index(k) + 1) for k in held}
    assert got == want


def test_slices_keep_what_is_missing(spark):
    systems = spark.createDataFrame([(1, 10, 1, 3), (1, 11, 5, 4)], "score int, system_id int, first int, last int")
    measures = spark.createDataFrame([(1, 1, 7, "a"), (1, 1, 9, "b"), (1, 3, 8, "c")], "score int, number int, ord int, x string")
    got = [(r["number"], r["found"], r["n_same"], r["x"]) for r in rows_of(slicing.slice_measures(systems, measures, ["score"], "number", ["ord"]).orderBy("number"))]
    assert got == [(1, True, 2, "b"), (2, False, 0, None), (3, True, 1, "c")]
    assert [r["contiguous"] for r in rows_of(slicing.contiguity(measures, ["score"], "number"))] == [False]


def scan(profile, start, stop, least):
    step, gap, walked = (1 if stop >= start else -1), False, 0
    for i in range(start, stop, step):
        walked += 1
        if walked < int(0.05 * abs(stop - start)):
            continue
        if profile[i] < least:
            gap = True
        elif gap:
            return i
    return start


def test_gap_matches_a_scan(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(60):
        n = rng.choice([5, 30, 90])
        profile = [rng.choice([0, 0, 5, 12]) if rng.random() < 0.5 else 12 for _ in range(n)]
        a, b = sorted((rng.randrange(n), rng.randrange(n)))
        for start, stop in ((a, b), (b, a)):
            key = (k, start > stop)
            want[key] = scan(profile, start, stop, 10)
            rows += [(k, start > stop, i, x, start, stop, 10) for i, x in enumerate(profile)]
    df = spark.createDataFrame(rows, "k int, back boolean, i int, ink int, start int, stop int, least int")
    got = {(r["k"], r["back"]): r["inner"] for r in rows_of(raster.gap_inward(df, ["k", "back"], "start", "stop", "least"))}
    assert got == {k: v for k, v in want.items()}


def preamble(text):
    import re

    out, depth, inside = [], 0, False
    for i, line in enumerate(text.split("\n")):
        if re.match(r"^\w+ =", line):
            return "\n".join(out).rstrip("\n"), "\n".join(text.split("\n")[i:])
        if re.match(r"^% automatically converted by musicxml2ly .+", line):
            continue
        if inside or re.search(r"\\header\b", line):
            depth = (depth if inside else 0) + line.count("{") - line.count("}")
            inside = depth > 0
            continue
        out.append(line)
    return "\n".join(out).rstrip("\n"), ""


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_preamble_matches_a_fold(spark, monkeypatch, block):
    monkeypatch.setattr(engraving, "BLOCK", block)
    rng = random.Random(9)
    pieces = ["\\header {", "\\header", "{", "}", "a { b", "% automatically converted by musicxml2ly x", "\\version \"2.24\"", "", "}} {", "\\header { a }", "{ {", "\\header { {"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(14))) + rng.choice(["", "\nPart =  {\n \\header {\n}", "\n"]) for _ in range(150)]
    df = engraving.split_documents(spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, text string"), ["i"])
    assert {r["i"]: (r["preamble"], r["rest"]) for r in rows_of(df)} == {-1: ("", "")} | {i: preamble(t) for i, t in enumerate(texts)}


def test_blocks_of_lines_compose():
    """A block's function gives the depth that its lines, taken one by one, end at."""
    rng = random.Random(10)
    for _ in range(3000):
        n = rng.randrange(12)
        net, header = [rng.randint(-3, 3) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        made = engraving.block_function(net, header)
        for start in range(9):
            depth = start
            for b, h in zip(net, header):
                depth = max(0, depth + b) if h or depth else 0
            assert engraving.depth_after(start, *made) == depth, (net, header, start)


def test_a_document_of_very_many_lines(spark):
    line = "\\header {\n x\n}\nkept\n"
    df = spark.createDataFrame([(1, line * 250_000 + "p = 1\nq")], "i int, text string")
    r = engraving.split_documents(df, ["i"]).collect()[0]
    assert r["preamble"] == "\n".join(["kept"] * 250_000) and r["rest"] == "p = 1\nq"


def test_merged_files(spark):
    df = spark.createDataFrame([(1, "\\version \"2\"\n\\header {\n}\np = {\n  \\set Staff.instrumentName = \"A\"\n}", "\\header {\n}")], "i int, text string, header string")
    assert engraving.merged(df, ["i"]).collect()[0]["merged"] == "\\version \"2\"\n\n\\header {\n}\n\np = {\n}"


def test_instrument_lines(spark):
    one = "x\n  \\set Staff.instrumentName = \"A\"\n\\set Staff.shortInstrumentName = \"B\"\ny"
    df = spark.createDataFrame([(one,), (one + "\n" + one,)], "text string").select(engraving.without_instruments(F.col("text")).alias("t"))
    assert [r["t"] for r in rows_of(df)] == ["x\ny", one + "\n" + one]


SCORE = """<?xml version="1.0"?><!DOCTYPE score-partwise PUBLIC "-//X" "http://localhost/no.dtd">
<score-partwise version="3.1"><work><work-number> Op. 1 </work-number></work><movement-title>T "x" \\</movement-title>
<identification><creator type="lyricist">L</creator><creator type="composer"> C </creator></identification>
<part-list><score-part id="P1"><part-name>A &amp; B</part-name><midi-device/></score-part></part-list>
<part id="P1">
<measure number="1" width="5"><print/><attributes><divisions>2</divisions><key number="1"><fifths>1</fifths></key><time><beats>3</beats><beat-type>4</beat-type></time></attributes>
<note default-x="4"><duration>6</duration></note><backup><duration>9</duration></backup><note><chord/><duration>6</duration></note></measure>
<measure number="2"><note><duration>6</duration><slur placement="above" type="start"/></note></measure>
<measure number="3"><attributes><key number="1"><fifths>2</fifths></key><clef><sign>G</sign></clef></attributes><note><duration>4</duration></note></measure>
<measure number="4"><note><duration>4</duration></note></measure></part>
<part id="P2"><measure number="1"><note/></measure><measure number="2"/><measure number="3"/><measure number="4"/></part></score-partwise>"""


@pytest.fixture(scope="module")
def score(spark):
    return spark.createDataFrame([("s", SCORE)], "doc string, xml string")


def test_nodes_round_trip_and_bad_documents(spark, score):
    nodes = xml_nodes(score, ["doc"])
    same = lambda a, b: a.tag == b.tag and a.attrib == b.attrib and (a.text or "").strip() == (b.text or "").strip() and len(a) == len(b) and all(map(same, a, b))
    back = rows_of(serialize(nodes, ["doc"], ["node_id"]))[0]["xml"]
    assert same(ElementTree.fromstring(back), ElementTree.fromstring(SCORE))
    odd = spark.createDataFrame([("a", None), ("b", " "), ("c", "<a>")], "doc string, xml string")
    assert [(r["doc"], r["node_id"]) for r in rows_of(xml_nodes(odd, ["doc"]))] == [("c", -1)]


def test_clean(score):
    out = rows_of(score_xml.clean(score, ["doc"]))[0]["xml"]
    assert out.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE score-partwise')
    root = ElementTree.fromstring(out)
    assert [c.tag for c in root] == ["part-list", "part", "part"] and root.find(".//midi-device") is None and root.find(".//print") is None
    assert [(m.get("number"), m.findtext("attributes/time/beats"), m.findtext("attributes/time/beat-type")) for m in root.findall("part[@id='P1']/measure")] == [
        ("1", "3", "4"), ("2", None, None), ("3", "2", "4"), ("4", None, None)]
    assert [m.findtext("attributes/time/beats") for m in root.findall("part[@id='P2']/measure")] == ["3", None, "2", None]
    assert [c.tag for c in root.find("part/measure/attributes")] == ["divisions", "time", "key"]
    assert root.find(".//slur").attrib == {"type": "start"} and root.find(".//note").attrib == {} and root.find(".//measure").attrib == {"number": "1"}


@pytest.mark.parametrize("mode", ["system", "measure"])
def test_snippets(spark, score, mode):
    systems = spark.createDataFrame([("s", 1, 1, 2), ("s", 2, 3, 5)], "doc string, system_id int, first int, last int")
    nodes = xml_nodes(score, ["doc"])
    got = {r["name"]: ElementTree.fromstring(r["xml"]) for r in rows_of(score_xml.snippet_names(score_xml.snippets(nodes, systems, ["doc"], mode)))}
    assert sorted(got) == ["measures/measure_0001.xml", "measures/measure_0002.xml", "measures/measure_0003.xml", "measures/measure_0004.xml", "systems/system_0001.xml", "systems/system_0002.xml"]
    second = got["systems/system_0002.xml"]
    assert [m.get("number") for m in second.findall("part[@id='P2']/measure")] == ["3", "4"]
    assert [(c.tag, c.get("number"), c.findtext("fifths")) for c in second.find("part/measure/attributes")] == [("divisions", None, None), ("time", None, None), ("key", "1", "2"), ("clef", None, None)]
    fourth = got["measures/measure_0004.xml"].find("part/measure/attributes")
    assert fourth.findtext("key/fifths") == ("1" if mode == "system" else "2")
    assert got["systems/system_0001.xml"].find("part-list/score-part/part-name").text == "A & B"


def test_header(spark, score):
    given = F.struct(*(F.lit(x).alias(f) for f, x in {"title": "", "subtitle": None, "composer": "-", "work_number": "K. 1", "copyright": None, "tagline": None}.items()))
    row = rows_of(header.with_block(header.merge(header.extract(score).withColumn("given", given))))[0]
    assert row["merged"]["composer"] == {"text": "", "confirmed": True}
    assert row["header"] == '\\header {\n  title = "T \\"x\\" \\\\"\n  opus = "K. 1"\n  tagline = ##f\n}'


def test_reconcile_and_listed_pages(spark):
    pages = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 2, 1, 3, 4), (1, 4, 1, 8, 9)], "s int, page int, ord int, first int, last int")
    book = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 2, 1, 3, 5), (1, 5, 1, 1, 1)], "s int, page int, ord int, first int, last int")
    listed = spark.createDataFrame([(1, 6, True)], "s int, page int, from_book boolean")
    got = {(r["page"], r["system"], r["error"]) for r in rows_of(reconcile.layouts(pages, book, ["s"], "page", ["ord"], ["first", "last"], listed))}
    assert got == {(2, 1, "measure_range"), (4, None, "missing_in_book"), (5, None, "missing_in_pages")}


def test_downstream_follows_the_graph():
    assert {b for a, b in artifacts.downstream() if a == "layout"} == {"layout", "images", "xml_snippets", "ly_snippets"}
