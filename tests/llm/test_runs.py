"""Periodic runs against every stretch tried by hand, and the query's columns on a whole small table."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from scorelake.llm import runs


def by_hand(w, shortest=6, least=4):
    """Maximal stretches of each period, kept under their least one."""
    found = {}
    for p in range(1, len(w) // least + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(shortest, least * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def left_over(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(words) if i not in gone)


def sequences():
    rng = random.Random(11)
    yield from ([], [0], [0] * 5, [0] * 6, [0, 1] * 3, [0, 1] * 4, [0] * 200, [0, 0, 1] * 40 + [0, 0, 0, 0, 0, 0])
    for k in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            part = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
            w[rng.randint(0, len(w)) :] = part * rng.randint(3, 7) + part[: rng.randrange(len(part))] + w[: rng.randrange(10)]
        yield w


def test_runs_match_every_stretch():
    n = 0
    for w in sequences():
        got = runs.find(np.array(w, np.int64))
        want = by_hand(w)
        assert [(s, e - s, p) for s, e, p in got.tolist()] == want, w
        n += len(want)
    assert n > 300


def test_hashes_that_mislead(monkeypatch):
    """With residues modulo 3 most comparisons are wrong; runs are right all the same."""
    monkeypatch.setattr(runs, "PRIME", np.uint64(3))
    monkeypatch.setattr(runs.Prefixes, "power", np.ones(1, np.uint64))
    monkeypatch.setattr(runs, "BASE", 2)
    for w in sequences():
        got = runs.find(np.array(w, np.int64))
        assert [(s, e - s, p) for s, e, p in got.tolist()] == by_hand(w), w


def test_small_blocks_of_pairs(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 50)
    for w in sequences():
        assert [(s, e - s, p) for s, e, p in runs.find(np.array(w, np.int64)).tolist()] == by_hand(w)


def test_long_text_of_one_word():
    assert runs.find(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]


def rewritten(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
    return words


def test_op11_columns(spark, data):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in runs.op11_periodic_runs(spark, data).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        words = rewritten(d, text)
        found = by_hand(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[d]
        assert r["n_runs"] == len(found)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(left_over(words, found).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5


@pytest.mark.parametrize("batch", [1, 1 << 20])
def test_odd_rows(spark, monkeypatch, batch):
    monkeypatch.setattr(runs, "BATCH", batch)
    rows = [(1, None, 1), (2, "", 2), (3, " \n\t ", 3), (4, "é é é é é é b", 4), (4, "é é é é é é b", 4), (None, "a\x0bb " * 4, 5), (6, "a\xa0b " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.detect(docs).collect()]
    assert sorted(got, key=repr) == sorted(
        [
            (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 7, [(0, 6, 1)], "é b"), (4, 7, [(0, 6, 1)], "é b"),
            (None, 8, [(0, 8, 2)], "a b"), (6, 50_000, [(0, 50_000, 1)], "a\xa0b"),
        ],
        key=repr,
    )
    assert runs.detect(docs.limit(0)).count() == 0
    assert runs.detect(docs).columns == ["doc_id", "text", *runs.NAMES]
