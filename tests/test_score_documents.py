"""Scores cleaned and cut one at a time against the same by node tables, on random documents."""

import random

import pytest

from scorelake.operators import score_documents, score_xml
from scorelake.sources.xml_nodes import xml_nodes
from tests.test_scores import SCORE


def measure(rng, number):
    def attributes():
        times = "".join(f'<time color="x">{rng.choice(["", "<beats>3</beats>", "<beats> 6 </beats>"])}{rng.choice(["", "<beat-type>8</beat-type>", "<beat-type>0</beat-type>"])}</time>' for _ in range(rng.randrange(3)))
        parts = [rng.choice(["", "<divisions>2</divisions>", "<divisions> 3\n</divisions>", "<divisions>x</divisions>", "<divisions>0</divisions>"]), times]
        parts += [f'<key number="{rng.randrange(1, 3)}"><fifths>{rng.randrange(9)}</fifths></key>' for _ in range(rng.randrange(2))]
        parts += [rng.choice(["", "<clef><sign>G</sign><print/></clef>", "<staff-details print-object='no' x='a&quot;b'/>"])]
        rng.shuffle(parts)
        return f"<attributes>{''.join(parts)}</attributes>"

    def note():
        kind = rng.choice(["note", "note", "backup", "forward", "sound"])
        inside = rng.choice(["", "<duration>1</duration>", "<duration> 4 </duration>", "<duration>1.5</duration>", "<duration/>", "<chord/><duration>2</duration>"])
        return f'<{kind} default-x="1" dynamics="3" a="&lt;&amp;">{inside}{rng.choice(["", "<slur placement=\'above\' type=\'start\'/>", " a &amp; b "])}</{kind}>'

    body = "".join(rng.choice([attributes, note, note, lambda: "<print><x/></print>"])() for _ in range(rng.randrange(6)))
    return f'<measure number="{number}" width="7">{body}</measure>'


def document(rng):
    # where numbers fall, snippets go by the numbers, and node tables by the document
    numbers = lambda: [rng.choice([k, k, k, "X1"]) for k in sorted(rng.choices(range(1, 9), k=rng.randrange(9)))]
    part = lambda k: f'<part id="P{k}" color="y">{"".join(measure(rng, n) for n in numbers())}</part>'
    head = rng.choice(["", "<!DOCTYPE a>", "<!DOCTYPE score-partwise PUBLIC 'x' 'y'>\n"])
    work = rng.choice(["", "<work><work-number>1</work-number></work><credit/>", "<other> x\n y </other>"])
    listed = "<part-list z='1'><score-part id='P1' font-size='2'><midi-device/><part-name>A &amp; B</part-name></score-part></part-list>"
    return f"{head}<score-partwise version='3.1' color='x'>{work}{listed}{''.join(part(k) for k in range(rng.randrange(4)))}</score-partwise>"


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(11)
    rows = [(k, document(rng)) for k in range(250)] + [(998, SCORE), (999, "<a><b/></a>"), (1000, "<a>"), (1001, " "), (1002, None)]
    return spark.createDataFrame(rows, "doc long, xml string").cache()


def test_cleaned_as_by_nodes(scores):
    want = {r["doc"]: r["xml"] for r in score_xml.clean(scores, ["doc"]).collect()}
    got = {r["doc"]: r["xml"] for r in score_documents.clean(scores, ["doc"]).collect()}
    assert got == want and len(got) == 252


@pytest.mark.parametrize("mode", ["system", "measure"])
def test_cut_as_by_nodes(spark, scores, mode):
    rng, rows = random.Random(12), []
    for k in [*range(245), 998, 999, 1000]:
        ends = sorted(rng.sample(range(1, 12), 4))
        rows += [(k, 20 + rng.randrange(5) * 10, ends[0], ends[1] - 1), (k, 10, ends[1], ends[2]), (k, 15, ends[3], ends[3] - 1)][: rng.randrange(1, 4)]
    systems = spark.createDataFrame(rows, "doc long, system_id int, first int, last int")
    of = lambda df: sorted(map(tuple, df.select("doc", "kind", "global_id", "xml").collect()))
    want = of(score_xml.snippets(xml_nodes(scores, ["doc"]), systems, ["doc"], mode))
    got = of(score_documents.snippets(scores, systems, ["doc"], mode))
    assert got == want and len(got) > 400


def test_a_measure_of_two_systems_is_there_once(spark):
    scores = spark.createDataFrame([("s", SCORE)], "doc string, xml string")
    systems = spark.createDataFrame([("s", 1, 1, 3), ("s", 2, 3, 4)], "doc string, system_id int, first int, last int")
    got = {(r["kind"], r["global_id"]): r["xml"] for r in score_documents.snippets(scores, systems, ["doc"]).collect()}
    assert len(got) == 6 and got["measure", 3].count('<measure number="3"') == 2
    assert got["measure", 3].count("<fifths>2</fifths>") == 1


def test_measures_go_by_their_numbers(spark):
    scores = spark.createDataFrame([("s", SCORE.replace('number="3"', 'number="0"'))], "doc string, xml string")
    systems = spark.createDataFrame([("s", 1, 0, 2), ("s", 2, 4, 4)], "doc string, system_id int, first int, last int")
    got = {(r["kind"], r["global_id"]): r["xml"] for r in score_documents.snippets(scores, systems, ["doc"]).collect()}
    one, two = got["system", 1], got["system", 2]
    assert one.index('<measure number="0"') < one.index('<measure number="1"') < one.index('<measure number="2"')
    assert "<fifths>1</fifths>" in two and "<fifths>2</fifths>" not in two


def test_a_score_moves_as_one_row(spark, scores):
    """No node tables: neither a shuffle nor a join by element."""
    assert "Exchange" not in score_documents.clean(scores, ["doc"])._jdf.queryExecution().executedPlan().toString()


def test_deep_documents(spark):
    deep = "<score-partwise>" + "<x>" * 5000 + "</x>" * 5000 + "</score-partwise>"
    got = score_documents.clean(spark.createDataFrame([(1, deep)], "doc int, xml string"), ["doc"]).collect()[0]["xml"]
    assert got.count("\n") == 2 * 5000 + 1
