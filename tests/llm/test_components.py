"""Components of links, from scratch and with links that come later, against union by hand."""

import random

import pytest

from scorelake.llm.common import keep
from scorelake.llm.ngram_join import are_stars, components, merged

SCHEMA = "a long, b long"


def by_hand(links):
    root = {x: x for pair in links for x in pair}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def roots_of(df):
    rows = df.collect()
    assert len(rows) == len({r["class"] for r in rows})
    return {r["class"]: r["root"] for r in rows}


@pytest.mark.parametrize("edges,expected", [([], True), ([(2, 1), (3, 1), (9, 5)], True), ([(3, 1), (3, 2)], False), ([(3, 2), (2, 1)], False)])
def test_are_stars(spark, edges, expected):
    assert are_stars(spark.createDataFrame(edges, "u long, v long")) is expected


def test_components_and_merged_match_by_hand(spark):
    rng = random.Random(4)
    first = [(k, k + 1) for k in range(-6, 6)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(25)]
    later = [(6, 130), (130, 6), (-6, 500), (500, 501), (700, 701), (120, 121), (701, 699)]
    first, later = ([p for p in x if p[0] != p[1]] for x in (first, later))
    comps = keep(components(spark.createDataFrame(first, SCHEMA)))
    assert roots_of(comps) == by_hand(first)
    assert roots_of(merged(comps, spark.createDataFrame(later, SCHEMA))) == by_hand(first + later)
    # links inside what is one component already change nothing
    assert roots_of(merged(comps, spark.createDataFrame([(-6, 6)], SCHEMA))) == by_hand(first)
