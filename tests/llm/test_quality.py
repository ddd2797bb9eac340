"""The quality model's grams against plain counting, its scores against its bags, and odd tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import quality

TEXTS = [b"", b" \n", b"one", b"one one", b"one two two two Three, 44 \xc3\xa9t\xc3\xa9 one two", b"a b " * 40, b"x" * 3000]


def counted(text: bytes) -> Counter:
    """Grams of a text, word by word."""
    words = text.split()
    out = Counter()
    for w in words:
        out.update(quality.grams(w))
    for a, b in zip(words[:-1], words[1:]):
        out[(zlib.crc32(a) * 0x9E3779B1 + zlib.crc32(b)) % 2**32 % quality.BUCKETS] += 1
        if a == b:
            out[quality.REPEAT] += quality.SHOWN
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 100_000])
@pytest.mark.parametrize("text", TEXTS)
def test_bag_counts_every_gram_whatever_the_slices(monkeypatch, text, size):
    monkeypatch.setattr(quality, "SLICE", size)
    monkeypatch.setattr(quality, "CACHED", max(4, size))
    found, counts = quality.bag(text, {})
    assert dict(zip(found.tolist(), counts.tolist())) == dict(counted(text))


@pytest.mark.parametrize("size", [1, 3, 100_000])
def test_score_is_the_mean_weight_of_the_bag(monkeypatch, size):
    monkeypatch.setattr(quality, "SLICE", size)
    monkeypatch.setattr(quality, "CACHED", max(4, size))
    model = {"weights": np.random.default_rng(2).normal(size=quality.BUCKETS), "bias": -0.3}
    got = quality.score_texts(TEXTS, model, quality.Known(model))
    for text, value in zip(TEXTS, got, strict=True):
        c = counted(text)
        mean = sum(model["weights"][g] * n for g, n in c.items()) / sum(c.values()) if c else 0.0
        assert value == pytest.approx(1 / (1 + math.exp(-(mean - 0.3))))


def test_totals_are_those_of_the_grams():
    words = sorted({w for t in TEXTS for w in t.split()} | {b"\xf0\x9f\x98\x80", b"<>", b"A1z", bytes([1, 255, 0]), b"ab"})
    weights = np.random.default_rng(4).normal(size=quality.BUCKETS)
    total, size = quality.totals(words, weights)
    for w, x, k in zip(words, total, size, strict=True):
        g = quality.grams(w)
        assert k == len(g) and x == pytest.approx(weights[g].sum())


def test_new_words_are_scored_without_listing_their_grams(monkeypatch):
    """A table where most words are new took some 24 us of CPU for each: its grams were hashed one by one."""
    model = {"weights": np.random.default_rng(6).normal(size=quality.BUCKETS), "bias": 0.2}
    texts = [b" ".join(b"w%dx%d" % (i, k) for k in range(50)) for i in range(40)] + [b"", b"one one"]
    alone = [quality.score_texts([t], model, quality.Known(model))[0] for t in texts]
    monkeypatch.setattr(quality, "grams", lambda word: pytest.fail("grams of one word"))
    assert quality.score_texts(texts, model, quality.Known(model)) == pytest.approx(alone)
    monkeypatch.setattr(quality, "STEP", 3)
    monkeypatch.setattr(quality, "SLICE", 60)
    assert quality.score_texts(texts, model, quality.Known(model)) == pytest.approx(alone)


def test_a_step_goes_down_the_loss(spark):
    """After training, labelled texts have a small loss; a model without passes has that of chance."""
    docs = spark.createDataFrame([(i, ("good calm words here " if i % 2 else "bad loud words there ") * (1 + i % 7)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = quality.score(docs, labels).collect()
    loss = -np.mean([math.log(r["score"] if r["doc_id"] % 2 else 1 - r["score"]) for r in rows])
    assert loss < 0.2 < math.log(2)


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (99, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "fine words"), (1, "fine words"), (2, "poor"), (3, None), (None, "fine words")], "doc_id long, text string")
    odd = docs.withColumn("Score", F.lit("kept?")).withColumn("weight", F.lit(1)).withColumn("_id", F.lit(2))
    got = quality.score(odd, labels)
    assert got.columns == ["doc_id", "text", "weight", "_id", "score"]
    rows = got.collect()
    assert len(rows) == 5 and len({r["score"] for r in rows if r["text"] == "fine words"}) == 1  # repeats score alike
    assert next(r for r in rows if r["text"] == "fine words")["score"] > next(r for r in rows if r["doc_id"] == 2)["score"]  # a tie of labels is class 1
    assert quality.score(odd.limit(0), labels).count() == 0


def test_the_bound_on_bags_leaves_documents_out_of_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good calm" if i % 2 else "bad loud") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "MOST_BYTES", 3000)
    rows = quality.score(docs, labels).collect()
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in rows) and len(rows) == 40
