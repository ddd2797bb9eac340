"""Layouts and problems from facts of sheets against those by node tables, on random archives."""

import random

from pyspark.sql import functions as F

from scorelake.operators import recognition, sheet_facts
from scorelake.sources.tables import materialize


def sheet(rng):
    number = lambda: rng.choice(["", "x", "7", " 12 ", "-3", "40", "250"])
    point = lambda: rng.choice(["", f'<point x="1" y="{rng.choice(["3.5", "10", "bad", "12.5", ""])}"/><point y="99"/>'])
    line = lambda: f"<line>{point()}</line>"
    staff = lambda: f'<staff left="{number()}" right="{number()}">{rng.choice(["", f"<lines>{line() * rng.randrange(3)}{line()}</lines><lines/>"])}</staff>'
    part = lambda: f"<part>{''.join(staff() for _ in range(rng.randrange(3)))}</part>"
    glyph = lambda: f'<head><bounds x="{number()}" y="{number()}" w="5" h="{number()}"/><bounds x="1" y="1" w="1" h="1"/></head>'
    sig = lambda: f"<sig>{rng.choice(['', f'<inters>{glyph()}<other/>{glyph()}</inters>'])}</sig>"
    stacks = lambda: "".join(f'<stack id="{k}" left="{number()}" right="9"/>' for k in range(rng.randrange(4)))
    systems = lambda: "".join(f'<system id="{k}">{stacks()}{part() * rng.randrange(3)}{sig() * rng.randrange(2)}</system>' for k in rng.sample(range(9), rng.randrange(4)))
    size = rng.choice(['<picture width="900" height="300"/>'] * 9 + ['<picture width="9"/>', ""])
    scale = rng.choice(["", '<scale><interline main="11"/></scale>', '<scale><interline main="x"/></scale>'])
    return rng.choice([f"<sheet>{scale}{size}<page>{systems()}</page><page><system id='1'/></page></sheet>"] * 12 + ["<sheet>", "", " \n", "<other/>"])


def documents(seed):
    rng, rows = random.Random(seed), []
    for k in range(60):
        n = rng.randrange(4)
        listed = rng.sample(range(1, n + 1), n) + rng.choice([[], [], [], [], [9], [1]])
        page = lambda: rng.choice(["", "<page/>", '<page delta-measure-id="3"/><page delta-measure-id="8"/>'])
        book = "".join(f'<sheet number="{x}">{page()}</sheet>' for x in listed)
        if rng.random() < 0.93:
            rows.append((k, "book.xml", None, rng.choice([f"<book>{book}</book>"] * 12 + ["<book>", None]), None))
        rows += [(k, f"sheet#{x}/sheet#{x}.xml", x, sheet(rng), None) for x in range(1, n + 1 + (rng.random() < 0.2))]
    return [*rows, (100, None, None, None, "no archive"), (101, "book.xml", None, "<book/>", None), (102, "book.xml", None, "<book/>", None), (102, "sheet#1/sheet#1.xml", 1, None, "damaged")]


def test_facts_as_by_nodes(spark):
    found = materialize(spark.createDataFrame(documents(5), "id int, name string, sheet int, xml string, error string"))
    nodes = recognition.node_table(found, ["id"])
    told = recognition.problems(found, nodes, ["id"])
    layouts = recognition.layouts_of(nodes.where("node_id >= 0").join(told.where("fatal").select("id").distinct(), "id", "left_anti"), ["id"])
    want = []
    for r in layouts.collect():
        for p in r["sheets"]:
            want += [(r["id"], p["sheet"], s["global_id"], *s["bounds"], *s["measure_range"]) for s in p["systems"] or ()]
    got = sheet_facts.read(found, ["id"]).cache()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.where("reason IS NULL").select("id", "sheet", "system", "x", "y", "width", "height", "first_measure", "last_measure").collect())
    of = lambda df: sorted(map(repr, df.select("id", "name", "reason", "detail", "fatal").collect()))
    assert of(got.where("reason IS NOT NULL")) == of(told)
    assert len(want) > 20 and got.where("reason IS NOT NULL").select("reason").distinct().count() >= 8


def test_documents_meet_as_facts(spark):
    """Texts stay where they are parsed: one shuffle, by archive, of what a layout needs."""
    rows = [(1, "book.xml", None, "<book><sheet number='1'/></book>", None), (1, "sheet#1/sheet#1.xml", 1, "<sheet><picture width='9' height='8'/><page><system/></page></sheet>", None)]
    made = sheet_facts.read(spark.createDataFrame(rows, "id int, name string, sheet int, xml string, error string").repartition(2, F.col("name")), ["id"])
    assert [(r["sheet"], r["system"], r["height"]) for r in made.collect()] == [(1, 1, 7)]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan
