import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import ann, chat, decontaminate, html_text, line_dedup, mixing, ngram_join, quality, secrets, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def odd_docs(spark, extra=""):
    """Nulls, empties, a very long text, ties, repeated rows and clashing column names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "b"), (4, LONG, "en", "a"), (5, base, "en", "c"),
        (6, base, "en", "d"), (7, base + " more", "en", "a"), (7, base + " more", "en", "a"), (8, "one two", "en", "b"),
        (9, "One TWO", "en", "b"), (None, "no id here at all, none", "en", "a"),
    ]
    df = spark.createDataFrame(rows, DOCS)
    # names that the operators use themselves
    return df.select("*", *(F.lit(7).alias(n) for n in ("class", "_row", "spans", "size", "token", "pos", "h1", "a", "rank")))


def test_secrets_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["password", '"token"', "API_KEY", "apikey", "Secret", ":", "=", " ", "  ", "'", '"', "AKIA", "0f", "é", "abcdef", "x1", "\n", "9" * 30, "AKIA" + "Z" * 16, "deadbeef" * 3, "=="]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25))), "s%d" % (i % 3)) for i in range(300)]
    rows += [(300, None, "a"), (301, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    base = {"assign", "access", "hex"}
    got = {
        r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in base]
        for r in secrets.scan(df).collect()
    }
    assert got == {i: brute.secrets(t) for i, t, _ in rows}


def test_secret_standing(spark):
    wide, own = "token = Abcdef9871", "token = Zyxwvu5432"
    rows = [(i, wide, f"s{i}") for i in range(4)] + [(9, own, "s0"), (10, own, "s0")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    standing = {r["doc_id"]: r["spans"][0]["standing"] for r in got}
    assert standing == {0: "example", 1: "example", 2: "example", 3: "example", 9: "live", 10: "live"}
    assert {r["spans"][0]["n_repos"] for r in got if r["doc_id"] > 8} == {2}


def test_secrets_odd_rows(spark):
    assert secrets.scan(odd_docs(spark)).count() == 11
    assert secrets.scan(odd_docs(spark).limit(0)).count() == 0


def test_fit_meets_budgets():
    rng = random.Random(1)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 4) for _ in sizes]
        whole = sum(a * b for a, b in zip(sizes, counts))
        budget = rng.randint(0, whole + 5)
        take = mixing.fit(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(a * b for a, b in zip(sizes, take))
        assert got <= budget
        even = [c * budget // whole for c in counts]
        left = [c - min(e, c) for c, e in zip(counts, even)]
        reach = {0}
        for a, c in zip(sizes, left):
            reach = {r + k * a for r in reach for k in range(c + 1)}
        if budget < whole:
            start = sum(a * e for a, e in zip(sizes, even))
            assert got == start + max(r for r in reach if start + r <= budget)


def water_fill(sizes, weights, share, cap):
    budget, top = share * sum(sizes), [cap * s for s in sizes]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = budget - sum(target[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / w > top[i]}
        if not above:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in above:
            target[i] = top[i]
        open_ -= above
    return target


def test_targets_and_mix(spark):
    rng = random.Random(5)
    names = ["a", "B", "é", "z", None]
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(names[: 5 if i % 2 else 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    order = ["B", "a", "z", "é", None]  # code points, null last
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in order]
    want = water_fill(sizes, [3, 1, 2, 3, 1], 1.5, 2.0)
    key = lambda n: "n" if n is None else "s" + n
    assert {r["src"]: r["source_size"] for r in got} == {key(n): s for n, s in zip(order, sizes)}
    for n, t in zip(order, want):
        mine = [r for r in got if r["src"] == key(n)]
        assert mine[0]["target"] == pytest.approx(t)
        assert abs(sum(r["taken"] for r in mine) - t) <= 40
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix(df).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_odd_rows(spark):
    df = odd_docs(spark)
    assert mixing.mix(df).count() == 11
    kept = mixing.mixed(df)
    assert kept.columns == [*df.columns, "copies"]
    assert kept.where("copies > 2").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0


def near_copies(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.6:
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 20, 60, 150]))]
            if rng.random() < 0.4:
                words += passage
            bases.append(words)
        rows.append((rng.randrange(10_000), " ".join(words).upper() if rng.random() < 0.2 else "\n".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_matches_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # all passages common, tiny blocks, pairs held back
        monkeypatch.setattr(ngram_join, "LOCAL_COMMON", 3)
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
        monkeypatch.setattr(ngram_join, "ROUNDS", ((1, None), (None, 1), (None, 2), (None, None)))
    rows = near_copies(seed) + [(3, None), (4, ""), (4, " \t")]
    ids = {}
    rows = [r for r in rows if ids.setdefault(r[0], r) == r]
    want = brute.components(rows)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: want[i] for i, (d, _) in enumerate(rows)}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(brute.shingles(t)) for d, t in rows}


def test_ngram_join_odd_rows(spark):
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.join(odd_docs(spark)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 5), (7, 5), (8, 8), (9, 8), (None, None)], key=str
    )
    stay = ngram_join.representatives(odd_docs(spark))
    assert sorted((r["doc_id"] for r in stay.collect()), key=str) == sorted([1, 2, 3, 4, 5, 8, None], key=str)
    assert ngram_join.join(odd_docs(spark).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu words here</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy this now</div>
<article><h1>Head &amp; line</h1><p><b>First
  part&nbsp;of</b> it.<br><p>Second &lt;one&gt; &copy</p><aside>Side note</aside><p></p></article>
<div class="comments"><p>Reader says a lot of words here, so many words that it is long</p></div><footer>Foot &middot; er</footer>"""


def test_html_text(spark):
    want = "Head & line\nFirst part of it.\nSecond <one> ©"
    df = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "<nav>x</nav>"), (5, "<p>Just <i>words</i> here<p>and more &am")], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["main"]) for r in html_text.main_text(df, name="main").collect()]
    assert sorted(got) == [(1, want), (1, want), (2, ""), (3, ""), (4, ""), (5, "Just words here\nand more &am")]
    assert html_text.main_text(df.limit(0), name="main").count() == 0


def test_greatest_region_matches_brute_force():
    rng = random.Random(4)
    weights = html_text.FIXED | {"word": 1.0, "<p": -2.0, "/p": -1.5, "<nav": -9.0}
    places = [html_text.IN, html_text.IN, html_text.WITHIN, html_text.BESIDE, html_text.OUT]

    def value(part):
        total = 0.0
        for kind, n, _, place in part:
            w = n * weights["word"] if kind == "word" else max(-html_text.MOST, weights[kind])
            total += {html_text.IN: w, html_text.WITHIN: abs(w), html_text.BESIDE: -abs(w), html_text.OUT: 0}[place]
        return total

    for _ in range(200):
        found = [[*rng.choice([("word", rng.randint(0, 4), "x"), ("<p", 0, None), ("/p", 0, None), ("<nav", 0, None)]), rng.choice(places)] for _ in range(rng.randint(0, 14))]
        best = max((value(found[a:b]) for a in range(len(found) + 1) for b in range(a, len(found) + 1)), default=0)
        a, b = html_text.region(found, weights)
        assert value(found[a:b]) == pytest.approx(max(best, 0))


def test_nearest_recall_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    same = x[40].tolist()
    rows += [(2000 + i, same) for i in range(60)]
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0, None] + [0.0] * 14), (3080, [float("inf")] * 16), (3100, [1.0, 2.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("shard", F.lit(1))
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.array([i for i, _ in rows[:1560]])
    v = np.array([np.array(e, np.float32) for _, e in rows[:1560]]).astype(np.float64)
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(got) == sorted(queries)
    hits = 0
    for q in queries:
        score = v @ v[list(ids).index(q)]
        true = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:20]
        assert len(got[q]) == 20
        by_id = dict(zip(ids.tolist(), score.tolist()))
        assert all(s == pytest.approx(by_id[i], abs=1e-12) for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        hits += len({i for _, i in true} & {i for i, _ in got[q]})
    assert hits / (20 * len(queries)) >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(6)
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", "\\", "\\<|", "a\\n<\\|", "", None, "é " * 300, "x " * 1500, "[INST", "\n\n", "<<SYS>>"]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool\nx", None])
            rows.append((c, t, role, rng.choice(odd)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(0))
    made = chat.windows(df, budget=300, history=100)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in range(30):
        turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert [(x["role"], x["text"]) for x in back[c]["turns"]] == turns
        assert back[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
    system = [r for r in made.collect() if r["conv_id"] == 0]
    assert len(system) > 1 and all(r["formatted"].startswith("<|turn|>system\n") for r in system)
    assert chat.windows(df.limit(0)).count() == 0


def test_suffix_array_and_search_match_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        s = np.concatenate([rng.integers(1, 5, n), [0]])
        sa = decontaminate.suffix_array(s)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        index = decontaminate.FMIndex(s)
        for k in (1, 2, 3):
            patterns = rng.integers(1, 9, (20, k))
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi):
                want = [i for i in range(n - k + 1) if (s[i : i + k] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontaminate_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of", "Ünder", "x9", "and", "q"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(12, None)]
    rows = []
    for i in range(80):
        words = rng.choices([*vocabulary, "other", "words"], k=rng.randint(0, 40))
        if i % 3 == 0:
            words += (items[i % 12][1] or "").upper().split() + ["tail"]
        rows.append((i, ", ".join(words)))
    rows += [(100, None), (101, ""), (102, LONG + " " + (items[11][1] or ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_x", F.lit(1))
    got = decontaminate.annotate(docs, spark.createDataFrame(items, "item_id long, text string"))
    for r in got.collect():
        text = dict(rows)[r["doc_id"]]
        hit = sum(s["end"] - s["start"] for s in r["_spans"])
        assert (r["_n_words"], hit, r["_items"]) == brute.contaminated(text, items), r["doc_id"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.annotate(docs, none).where("size(_spans) > 0").count() == 0


def test_cut_leaves_no_window(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    text = "Before it, " + item.upper().replace(" ", ", ") + "! After."
    docs = spark.createDataFrame([(1, text), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.annotate(docs, bench, remove=True).collect()}
    assert got == {1: "Before it, ! After.", 2: "clean text"}


def test_large_benchmark_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = [(i, f"a{i} b c d e f g h i j k") for i in range(9)]
    docs = spark.createDataFrame([(1, items[2][1] + " " + items[7][1])], "doc_id long, text string")
    got = decontaminate.annotate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()[0]
    assert (got["_n_words"], sum(s["end"] - s["start"] for s in got["_spans"]), got["_items"]) == brute.contaminated(items[2][1] + " " + items[7][1], items)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    common = [f"this line is common number {i}" for i in range(6)]
    rows = []
    for i in range(200):
        lines = [f"own line {i} {j} of text" for j in range(rng.randint(0, 4))]
        for c in common[: 1 + i % 6]:
            if rng.random() < 0.5:
                lines.insert(rng.randint(0, len(lines)), c)
        rows.append((i, "\n".join(lines), f"s{rng.randrange(10)}"))
    copied = "copied first line here\ncopied second line here\ncopied third line here"
    rows += [(500 + i, copied, f"s{i % 10}") for i in range(30)]
    rows += [(600, None, "s1"), (601, "", None), (602, common[0], "s2"), (603, "\n\n", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h1", F.lit(1)).withColumn("site", F.lit("x"))
    got = line_dedup.clean(df, min_sites=4)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    want = brute.line_dedup(rows, 4)
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect() if r["text"] is not None) == sorted(w for w in want if w[1] is not None)
    assert any(w[3] for w in want) and all(w[3] == 0 for w in want if 500 <= w[0] < 530)
    assert line_dedup.clean(df.limit(0)).count() == 0


def test_line_dedup_by_texts(spark):
    """Footers of three lines, one inside many copies; copies and near copies stay."""
    footer = ["first line of the footer", "second line of the footer", "third line of the footer"]
    closing = ["inside of the copied texts", "a closing line among copies"]
    rng = random.Random(4)

    def own(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    rows = [(i, "\n".join([own(12), own(9), "", *footer]), f"s{i % 10}") for i in range(60)]
    rows += [(100 + i, "\n".join([own(30), *closing]), f"s{i % 10}") for i in range(30)]
    copied = [f"copied line {j} of a text that stands everywhere" for j in range(6)]
    rows += [(1000 + i, "\n".join([*copied, *closing, *footer]), f"s{i % 10}") for i in range(1000)]
    near = [f"near copied line {j} of another text" for j in range(8)]
    rows += [(3000 + i, "\n".join([*near[: i % 8], f"changed in {i}", *near[i % 8 + 1 :]]), f"s{i % 10}") for i in range(200)]
    # long lines with changed words among lines that stay
    base = [own(40) for _ in range(3)]
    for i in range(300):
        words = [x.split() for x in base]
        for x in words:
            x[rng.randrange(40)], x[rng.randrange(40)] = own(1), own(1)
        rows.append((5000 + i, "\n".join([" ".join(words[0]), "a line between long ones", " ".join(words[1]), " ".join(words[2]), "the last line of these"]), f"s{i % 10}"))
    rows += [(4000, "\n".join(footer), "s1"), (4001, None, "s2"), (4002, "\n \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.clean(df, by_texts=True).collect()}
    fixed = {*footer, *closing}
    for i, t, _ in rows:
        left = "\n".join(x for x in t.split("\n") if x not in fixed) if t and i < 3000 else t
        assert got[i]["text"] == left, i
    assert {got[i]["n_removed"] for i in range(60)} == {3} and {got[i]["n_removed"] for i in range(1000, 2000)} == {5}
    assert line_dedup.clean(df.limit(0), by_texts=True).count() == 0


def labelled(spark, seed=3):
    rng = random.Random(seed)
    calm = [f"calm{i}" for i in range(300)]
    bad = ["grubvex", "grubvost", "slimp", "worgle"]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(calm, k=rng.randint(5, 60))
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 8)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        good = int(i % 5 != 0)
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, good, toxic))
    docs += [(900, None), (901, ""), (902, LONG)]
    labels += [(i, a, b) for i, a, b in labels[:20]] + [(950, 1, 1), (901, None, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("x", F.lit(2)),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_hold_out(spark, module, label):
    docs, labels = labelled(spark)
    from scorelake.llm.labelled import remainder

    scored = module.score(docs, labels, label, remainder("doc_id", 3) != 1).where(remainder("doc_id", 3) == 1)
    known = labels.dropna().dropDuplicates(["doc_id"])
    got = scored.join(known, "doc_id").select("score", label).collect()
    right = sum((r["score"] >= 0.5) == bool(r[label]) for r in got)
    assert len(got) > 100 and right / len(got) >= 0.95
    every = module.score(docs, labels, label)
    assert every.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert every.count() == docs.count() and every.columns == [*docs.columns, "score"]
    # one class or no labels at all: a constant
    one = module.score(docs, labels.where(F.col(label) == 1), label).select("score").distinct().collect()
    assert [r["score"] for r in one] == [1.0]
    none = module.score(docs, labels.limit(0), label).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.0]


def test_sample_keeps_one_row_of_an_id(spark):
    from scorelake.llm.labelled import sample

    rows = [(1, f"text {i}") for i in range(500)] + [(i, f"own {i}") for i in range(2, 12)] + [(2, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in sample(docs, labels, "toxic", 4).collect())
    assert len(got) == 8 and sum(r[1] for r in got) == pytest.approx(11)
    assert got == sorted(tuple(r) for r in sample(docs.repartition(7), labels, "toxic", 4).collect())
    every = sample(docs, labels, "toxic", 50).collect()
    assert len(every) == 11 and sum(r["text"].startswith("text ") for r in every) == 1


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(7)
    x, y, w = rng.integers(0, 8, 60).astype(float), rng.integers(0, 2, 60).astype(float), rng.uniform(0.5, 2, 60)
    xs, ys = toxicity.isotonic(x, y, w)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    fit = np.interp(x, xs, ys)
    # pooled means: within each level the fit is the weighted mean
    for level in np.unique(fit):
        at = fit == level
        assert np.average(y[at], weights=w[at]) == pytest.approx(level)
