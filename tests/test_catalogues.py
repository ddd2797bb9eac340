"""Catalogues of any shape: unknown keys survive, paths are set and taken away."""

import json
import random

from pyspark.sql import functions as F

from scorelake.operators import catalogues

CHANGE = "id int, path array<string>, value string"


def by_hand(text, changes):
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        return None
    if not isinstance(doc, dict):
        return None
    for path, value in changes:
        at = doc
        for key in path[:-1]:
            if not isinstance(at.get(key), dict):
                at[key] = {}
            at = at[key]
        if value is None:
            at.pop(path[-1], None)
        else:
            at[path[-1]] = json.loads(value)
    return doc


def test_changes_match_by_hand(spark):
    rng = random.Random(3)
    base = {"command": ["new", "x"], "input": {"absolute": "/a b", "page_range": [1, 2]}, "later": {"un known": {"ä": [1, {"b": None}], "n": 1234567890123456789}}, "empty": {}, "q\"u\\o": "t\ne", "stages": {"pages": {"outputs": ["a"], "extra": True}}}
    docs = {k: json.dumps({x: v for x, v in base.items() if rng.random() < 0.8}, ensure_ascii=False) for k in range(30)}
    docs |= {30: None, 31: "{", 32: "[1]", 33: "3", 34: "{}", 35: " {\"a\": 1} "}
    paths = [("stages", "pages", "outputs"), ("stages", "omr", "outputs"), ("input", "absolute"), ("command",), ("new.key",), ("later", "un known", "ä"), ("command", "deep"), ("empty", "a", "b", "c")]
    changes = {}
    for k in docs:
        own = rng.sample(paths, rng.randrange(5))
        own = [p for p in own if not any(p != o and o == p[: len(o)] for o in own)]
        changes[k] = [(p, rng.choice([None, "1", '"a\\"b"', '{"x": [2]}', "[]"])) for p in own]
    rows = [(k, list(p), v) for k, c in changes.items() for p, v in c] + [(99, ["a"], "1")]
    table = spark.createDataFrame(list(docs.items()), "id int, json string")
    told = spark.createDataFrame(rows, CHANGE).withColumn("value", F.parse_json("value"))
    done = catalogues.write(catalogues.changed(catalogues.read(table, ["id"]), told, ["id"]), ["id"])
    got = {r["id"]: json.loads(r["json"]) if r["json"] is not None else None for r in done.collect()}
    want = {k: by_hand(t, changes[k]) for k, t in docs.items()}
    # a key that is taken away below what isn't there leaves an object behind in both
    assert got == want and sum(bool(c) for c in changes.values()) > 20


def test_without_changes(spark):
    table = spark.createDataFrame([(1, '{"b": 1, "a": {"c": [1, 2.5, null, "x"]}}')], "id int, json string")
    none = spark.createDataFrame([], CHANGE).withColumn("value", F.parse_json("value"))
    done = catalogues.write(catalogues.changed(catalogues.read(table, ["id"]), none, ["id"]), ["id"])
    assert done.collect()[0]["json"] == '{"a":{"c":[1,2.5,null,"x"]},"b":1}'
