"""Header fields of odd documents, read at once."""

import re

from scorelake.operators import header

FIELDS = ("title", "composer", "work_number", "copyright")


def test_fields_are_read_in_one_parse(spark):
    score = lambda x: f"<score-partwise>{x}</score-partwise>"
    documents = {
        1: (score("<movement-title/><movement-title> A<!-- x -->B</movement-title>"), ("A", "", "", "")),
        2: (score("<work><work-number><![CDATA[<1>]]>&amp;</work-number></work><identification><rights>\u00a9 ; , \u2028</rights></identification>"), ("", "", "<1>&", "\u00a9 ; , \u2028")),
        3: (score("<identification><creator>x</creator><creator type='composer'/><creator type='composer'>C</creator></identification>"), ("", "", "", "")),
        4: ("<other><movement-title>T</movement-title></other>", ("", "", "", "")),
        5: ("", ("", "", "", "")),
        6: (None, ("", "", "", "")),
        7: ("<!DOCTYPE score-partwise SYSTEM 'http://localhost/none.dtd'>" + score("<movement-title><b/> T</movement-title><identification><creator type='composer'>C</creator></identification>"), ("T", "C", "", "")),
    }
    found = header.extract(spark.createDataFrame([(k, x) for k, (x, _) in documents.items()], "k int, xml string"))
    assert found.columns == ["k", "xml", "info"]
    assert {r["k"]: tuple(r["info"][f] for f in FIELDS) for r in found.collect()} == {k: want for k, (_, want) in documents.items()}
    plan = found.select(*(f"info.{f}" for f in FIELDS))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("regexp_replace", plan)) == 1
