"""Source divergence against exact integers by hand, in one block and in many."""

import random
import re
from collections import Counter, defaultdict

import pytest

from scorelake.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(docs, least_docs=3, ranks=200):
    docs = [(la or "", so or "", TERM.findall((t or "").translate(LOWER))) for la, so, t in docs]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for la, so, words in docs:
        seen[la].update(set(words))
        count[la, so].update(words)
    kept = {la: sorted(t for t, n in c.items() if n >= least_docs) for la, c in seen.items()}
    share = {}
    for la, so in count:
        for name, c in (((la, so), count[la, so]), (la, sum((count[x] for x in count if x[0] == la), Counter()))):
            total = sum(c[t] for t in kept[la])
            share[name] = [1 + 10**9 * (c[t] + 1) // (total + len(kept[la])) for t in kept[la]]
    f = lambda p, q: (p - q) * (p - q) // q
    out = []
    for la, so in count:
        mine = share[la, so]
        pair = [(o, sum(map(f, mine, share[la, o]))) for x, o in count if x == la and o != so]
        own = [(t, f(p, q)) for t, p, q in zip(kept[la], mine, share[la]) if count[la, so][t] and p > q]
        for part, rows in (("pair", pair), ("term", own)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(la, so, part, item, v, k + 1) for k, (item, v) in enumerate(rows) if part == "pair" or k < ranks]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "Of", "é", "ZÜ", "\U0001f600x", "￮", "x-y", "a1b", "o'clock"] + [f"w{chr(97 + k)}" for k in range(26)]
    docs = []
    for _ in range(120):
        la = rng.choice(["en", "en", "en", "fr", None, ""])
        so = rng.choice(["s1", "s2", "s3", "s1", "S'4", None])
        docs.append((la, so, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 5, 60])))))
    return docs + [("xx", "only", "seldom words"), ("yy", "a", None), ("yy", "b", ""), ("yy", "b", "once"), ("en", "silent", "12 .."), docs[0], docs[0]]


@pytest.mark.parametrize("block,held", [(1 << 18, 400_000), (7, 3), (1, 1)])
def test_audit_matches_by_hand(spark, monkeypatch, block, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    docs = corpus(block)
    df = spark.createDataFrame(docs, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS p").repartition(3)
    for ranks in (200, 4):
        got = sorted(tuple(r) for r in divergence.audit(df, ranks=ranks).collect())
        assert got == by_hand(docs, ranks=ranks)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    one = divergence.audit(spark.createDataFrame([(None, None, None)] * 2, "lang string, source string, text string"))
    assert one.count() == 0
