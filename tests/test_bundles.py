"""Bundles: sources, undone stages, logs and catalogues with odd input."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scorelake.operators import artifacts, bundles

from .conftest import rows_of


def test_source_problems(spark):
    rows = [("a/b.PDF", True, None), ("a.pdf/b", True, "format"), (".pdf", True, "format"), ("b.pdf", False, "missing"), ("b.pdf", None, "missing"), ("b.xml", True, "format")]
    got = spark.createDataFrame(rows, "path string, exists boolean, want string").select("want", bundles.source_problem(F.col("path"), F.col("exists"), [".pdf"]).alias("got"))
    assert [r["got"] for r in rows_of(got)] == [r["want"] for r in rows_of(got)]


def test_given_sources_win(spark):
    own = spark.createDataFrame([(1, "own1"), (2, "own2")], "b int, path string")
    given = spark.createDataFrame([(2, "given2"), (3, "given3")], "b int, path string")
    got = {r["b"]: (r["path"], r["is_given"]) for r in rows_of(bundles.chosen_sources(own, given, ["b"]))}
    assert got == {1: ("own1", False), 2: ("given2", True), 3: ("given3", True)}


def test_forcing_undoes_one_stage_of_given_bundles(spark):
    made = [(1, "musicxml", ["a", "lost"]), (1, "pages", ["p"]), (2, "musicxml", ["a"]), (3, "musicxml", [])]
    recorded = spark.createDataFrame(made, "b int, stage string, outputs array<string>")
    existing = spark.createDataFrame([(1, "a"), (1, "p"), (2, "a"), (3, "x")], "b int, path string")
    given = spark.createDataFrame([(1,), (1,), (3,), (9,)], "b int")
    left = bundles.after_forcing(existing, recorded, given, ["b"])
    assert sorted((r["b"], r["path"]) for r in rows_of(left)) == [(1, "p"), (2, "a"), (3, "x")]
    assert bundles.after_forcing(existing, recorded, given.limit(0), ["b"]).count() == 4


def test_log_goes_on(spark):
    log = spark.createDataFrame([(1, 0, "created", "t0"), (1, 1, "x", "t1")], "b int, seq long, event string, ts string")
    events = spark.createDataFrame([(1, "z", "t3"), (1, "y", "t2"), (2, "first", "t9")], "b int, event string, ts string")
    got = rows_of(bundles.appended(log, events, ["b"], ["ts", "event"]))
    assert sorted((r["b"], r["seq"], r["event"]) for r in got) == [(1, 2, "y"), (1, 3, "z"), (2, 0, "first")]


def test_catalogue_that_is_no_json(spark):
    got = rows_of(bundles.from_json(spark.createDataFrame([(1, "{"), (2, None), (3, '{"command":[]}')], "b int, json string"), ["b"]))
    assert [(r["b"], r["command"], r["stages"]) for r in got] == [(1, None, None), (2, None, None), (3, [], None)]


def test_failed_pages_go_and_a_failed_book_stops(spark):
    results = spark.createDataFrame([(1, False, True, None), (2, False, False, "torn"), (3, True, True, None)], "n int, book boolean, ok boolean, error string")
    assert sorted(r["n"] for r in rows_of(artifacts.succeeded(results, F.col("book")))) == [1, 3]
    with pytest.raises(PySparkException, match="book failed: torn"):
        artifacts.succeeded(results.withColumn("book", F.lit(True)), F.col("book")).collect()
