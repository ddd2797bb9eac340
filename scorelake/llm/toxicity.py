"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon of words and stems (learned from
labelled documents), nearness to second-person words, capitals, punctuation
and obfuscation rates. Every labelled document of a bounded sample serves all
three: it is measured with a lexicon learned from the other folds, and the
calibration uses what trees of the other folds say of it. Texts with the same
least word hash, such as copies, are in one fold.

The sample holds at most ``most`` documents of each class; it and the model go
through the driver, the corpus doesn't. Scoring is one pass without a shuffle.
Defined results: null and empty texts are scored like any other; without labels
of both classes every score is the share of label 1 (0 without labels); a
document with several labels counts once; repeated rows score alike; extra
columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import tidy
from scorelake.llm.decontaminate import words_of
from scorelake.llm.labelled import remainder, sample, scored

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Labelled documents of each class that are learned from, lexicon entries kept, and folds that learn from each other.
MOST, LEXICON, CROSS = 3000, 6000, 5
SECOND_PERSON = frozenset(
    w.encode()
    for w in "you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros".split()
)
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
MARKS = b"!?*#$%&@"
#: A letter, then a mark or digit, then a letter, inside one word.
HIDDEN = re.compile(rb"[a-zA-Z][0-9@$!*|+][0-9@$!*|+a-zA-Z]*[a-zA-Z]")
PLAIN = bytes.maketrans(b"013457@$!|+", b"oieastasilt")
NAMES = (
    "weight_rate strong_rate strong_count strong_kinds fair_rate fair_count best_mean person_rate person_near"
    " capital_rate mark_rate exclamation_rate hidden_rate hidden_strong log_words mean_word digit_rate"
).split()
#: Log odds from which a word counts as fair or strong evidence; few documents leave them in doubt.
FAIR, STRONG, DOUBT = 1.5, 3.0, 3.0
CACHED = 300_000


def stems(word: bytes) -> list[bytes]:
    """Its first 3 to 8 characters, where more follow, marked as stems."""
    t = word.decode("utf-8", "replace")
    return [b"^" + t[:k].encode("utf-8", "replace") for k in range(3, min(8, len(t) - 1) + 1)]


def terms(text: bytes) -> set[bytes]:
    words = set(words_of(text))
    return words | {s for w in words for s in stems(w)}


def likeness(text: bytes) -> int:
    """The least hash of its words: copies agree, and near copies mostly do."""
    words = list(set(words_of(text)))
    return int(pd.util.hash_array(np.array(words, dtype=object), categorize=False).min() >> np.uint64(1)) if words else 0


def learn_lexicons(train: DataFrame, most: int = LEXICON, folds: int = CROSS) -> list[dict[bytes, float]]:
    """Log odds of words and stems that label-1 documents show more often than the others.

    The first is learned from all documents, the others each without one fold.
    Documents count by their likeness, so that copies of one text count once.
    """

    def each(batches):
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = list(terms(text or b""))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.binary()), pa.array([likeness(text)] * len(found), pa.int64()), pa.array([y] * len(found), pa.int32())],
                        names=["term", "like", "y"],
                    )

    found = train.select("y", "text").mapInArrow(tidy(each), "term binary, like long, y int").distinct()
    fold = F.col("like") % folds
    counts = [F.sum(F.when(fold == k, F.col("y")).otherwise(0)).alias(f"bad{k}") for k in range(folds)]
    counts += [F.sum(F.when(fold == k, 1 - F.col("y")).otherwise(0)).alias(f"good{k}") for k in range(folds)]
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    least = max(2, min(4, n1 // 20))
    total = lambda of: sum((F.col(f"{of}{k}") for k in range(1, folds)), F.col(f"{of}0"))
    counted = found.groupBy("term").agg(*counts).withColumn("bad", total("bad")).withColumn("good", total("good"))
    odds = F.log((F.col("bad") / n1) / ((F.col("good") + 0.5) / n0)) * F.col("bad") / (F.col("bad") + DOUBT)
    # those that hold without a fold may miss by all, so twice as many are looked at
    rows = counted.where(F.col("bad") >= least).withColumn("odds", odds).where(F.col("odds") >= FAIR / 2)
    rows = rows.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(2 * most).collect()

    def without(k: int | None) -> dict[bytes, float]:
        best = []
        for r in rows:
            bad, good = r["bad"] - (r[f"bad{k}"] if k is not None else 0), r["good"] - (r[f"good{k}"] if k is not None else 0)
            weight = float(np.log((bad / n1) / ((good + 0.5) / n0))) * bad / (bad + DOUBT) if bad >= least else 0.0
            if weight >= FAIR:
                best.append((-weight * bad**0.5, bytes(r["term"]), weight))
        return {t: w for _, t, w in sorted(best)[:most]}

    return [without(k) for k in (None, *range(folds))]


class Weights(dict):
    """A bounded cache of words' weights: the best of the word and its stems, 0 if none is known."""

    def __init__(self, lexicon: dict[bytes, float], most: int = CACHED):
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        get = self.lexicon.get
        self[word] = found = max(get(word, 0.0), *(get(s, 0.0) for s in stems(word)), 0.0)
        return found


def features(texts: list[bytes], weights: Weights) -> np.ndarray:
    out = np.zeros((len(texts), len(NAMES)))
    for i, t in enumerate(texts):
        words = words_of(t)
        n, size = max(1, len(words)), max(1, len(t))
        weight = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
        strong = np.flatnonzero(weight >= STRONG)
        fair = int((weight >= FAIR).sum())
        people = SECOND_PERSON.intersection(words)
        near = 0.0
        if len(strong) and people:
            who = np.array([k for k, w in enumerate(words) if w in people])
            where = np.searchsorted(who, strong)
            gap = np.minimum(np.abs(who[np.minimum(where, len(who) - 1)] - strong), np.abs(who[np.maximum(where - 1, 0)] - strong))
            near = float(np.mean(gap <= 5))
        letters = size - len(t.translate(None, LETTERS))
        hidden = HIDDEN.findall(t)
        out[i] = (
            weight.sum() / n, len(strong) / n, min(len(strong), 50), min(len({words[k] for k in strong}), 50),
            fair / n, min(fair, 100), float(np.sort(weight)[-5:].mean()) if len(words) else 0.0,
            sum(w in people for w in words) / n if people else 0.0, near,
            (size - len(t.translate(None, UPPER))) / max(1, letters), (size - len(t.translate(None, MARKS))) / size,
            t.count(b"!") / n, len(hidden) / n, sum(weights[x.translate(PLAIN).lower()] >= STRONG for x in hidden),
            np.log1p(len(words)), sum(map(len, words)) / n, (size - len(t.translate(None, b"0123456789"))) / size,
        )
    return out


class Boosted:
    """Trees of fixed depth on binned features, logistic loss, second-order gains."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            f += self._grow(b, w * (y - p), np.maximum(w * p * (1 - p), 1e-9), w)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        node = np.zeros(len(g), np.int64)
        feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins)
        first = 0
        for level in range(self.depth):
            n = 2**level
            best = np.zeros(n)
            for j in range(b.shape[1]):
                key = node * self.bins + b[:, j]
                gs, hs, ws = (np.bincount(key, v, n * self.bins).reshape(n, -1).cumsum(axis=1) for v in (g, h, w))
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(ws < self.least) | (ws[:, -1:] - ws < self.least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(n), at]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feature[first : first + n] = np.where(better, j, feature[first : first + n])
                cut[first : first + n] = np.where(better, at, cut[first : first + n])
            here = first + node
            node = node * 2 + (b[np.arange(len(b)), feature[here]] > cut[here])
            first += n
        leaf = self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + 1)
        self.trees.append((feature, cut, leaf))
        return leaf[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, f, every = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            first = 0
            for level in range(self.depth):
                here = first + node
                node = node * 2 + (b[every, feature[here]] > cut[here])
                first += 2**level
            f += leaf[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing fit, by pooling adjacent violators; equal x are one point."""
    knots, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse, w)
    value = np.bincount(inverse, w * y) / weight
    pools: list[list[float]] = []
    for i, (v, k) in enumerate(zip(value.tolist(), weight.tolist(), strict=True)):
        pools.append([v, k, i, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[3]
    xs = [knots[i] for p in pools for i in (p[2], p[3])]
    return np.array(xs, np.float64), np.array([p[0] for p in pools for _ in range(2)], np.float64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed=None, most: int = MOST, doc_id: str = "doc_id", text: str = "text", folds: int = CROSS) -> dict:
    """The model: lexicon, trees and calibration knots."""
    taken = sample(docs, labels, label, most, allowed, doc_id, text)
    lexicon, *others = learn_lexicons(taken, folds=folds)

    def measure(batches):
        weights = [Weights(x, CACHED // folds) for x in others]
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            fold = [likeness(t) % folds for t in texts]
            found = [features([t], weights[k])[0].tolist() for t, k in zip(texts, fold, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("weight"), batch.column("luck"), pa.array(fold, pa.int32()), pa.array(found, pa.list_(pa.float64()))],
                names=["y", "weight", "luck", "fold", "x"],
            )

    rows = taken.mapInArrow(tidy(measure), "y int, weight double, luck long, fold int, x array<double>").toPandas()
    rows = rows.sort_values("luck", kind="stable")
    y, w, fold = rows["y"].to_numpy(np.float64), rows["weight"].to_numpy(np.float64), rows["fold"].to_numpy()
    if len(set(y)) < 2:
        return {"lexicon": lexicon, "trees": None, "share": float(y.mean()) if len(y) else 0.0}
    x = np.stack(rows["x"].to_numpy())
    told = np.empty(len(y))
    for k in range(folds):
        own = fold == k
        if own.any():
            told[own] = Boosted().fit(x[~own], y[~own], w[~own]).predict(x[own]) if (~own).any() else 0.0
    return {"lexicon": lexicon, "trees": Boosted().fit(x, y, w), "knots": isotonic(told, y, w)}


def score_texts(texts: list[bytes], model: dict, weights: Weights) -> np.ndarray:
    """Calibrated scores; within a calibrated step the trees' own order shows in the last thousandth."""
    if model["trees"] is None:
        return np.full(len(texts), model["share"])
    raw = model["trees"].predict(features(texts, weights))
    xs, ys = model["knots"]
    return 0.999 * np.interp(raw, xs, ys) + 0.001 / (1 + np.exp(-raw))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed=None, most: int = MOST, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``carry`` (default: all) and the score as ``name``, 0 to 1."""
    model = train(docs, labels, label, allowed, most, doc_id, text)
    return scored(docs, model, score_texts, lambda m: Weights(m["lexicon"]), text, name, carry)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents; labels only from rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, labels, "toxic", remainder("doc_id", FOLDS) != HELD_OUT, carry=["doc_id"])
    return out.select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
