"""The opN_ queries on whole small tables: against their SQL, or column by column against plain forms."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import ann, chat, decontaminate, html_text, line_dedup, mixing, ngram_join, queries, quality, secrets, toxicity
from tests.llm import brute
from tests.llm.test_operators import water_fill


def table(data, name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{data}/{name}.parquet'").fetchall()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, data), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    assert rows and rows == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)


def test_op1_columns(spark, data):
    texts = dict(table(data, "documents", "doc_id, text"))
    for r in secrets.op1_secret_scan(spark, data).collect():
        found = brute.secrets(texts[r["doc_id"]])
        kinds = Counter(x.split(":")[0] for x in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == sha(",".join(found))
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in kinds] == found
        assert r["n_live"] + r["n_example"] == len([x for x in r["spans"].split(",") if x])


def test_op2_columns(spark, data):
    docs = table(data, "documents", "doc_id, text, source")
    size = {d: len(brute.re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    names = sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    whole = {n: sum(size[d] for d, _, s in docs if s == n) for n in names}
    goal = dict(zip(names, water_fill([whole[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)))
    source, taken = {d: s for d, _, s in docs}, Counter()
    rows = mixing.op2_mix_sources(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], whole[s]) and r["target"] == pytest.approx(goal[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[n] - goal[n]) <= max(size.values()) for n in names)


def test_op4_rows(spark, data):
    pages = table(data, "pages", "page_id, url, html")
    got = {(r["page_id"], r["url"]): r for r in html_text.op4_html_text(spark, data).collect()}
    assert len(got) == len(pages)
    for i, url, page in pages:
        body = brute.re.search(r"<article>(.*)</article>", page, brute.re.S)[1]
        blocks = [" ".join(html_text.html.unescape(brute.re.sub("<br>", " ", brute.re.sub("</?b>", "", x))).split()) for x in brute.re.split("</?(?:p|h1)>", body)]
        want = "\n".join(x for x in blocks if x)
        assert (got[i, url]["text"], got[i, url]["n_chars"]) == (want, len(want))


def test_op5_recall(spark, data):
    rows = table(data, "embeddings", "vec_id, embedding")
    ids, v = np.array([i for i, _ in rows]), np.array([e for _, e in rows], np.float64)
    got = {}
    for r in ann.op5_nearest(spark, data).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        score = dict(zip(ids.tolist(), (v @ v[ids.tolist().index(q)]).tolist()))
        best = sorted((x for x in score if x != q), key=lambda x: (-score[x], x))[:20]
        assert [r["rank"] for r in got[q]] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-12) for r in got[q])
        hits += len({r["vec_id"] for r in got[q]} & set(best))
    assert hits >= 0.9 * 20 * len(asked)


def test_op6_columns(spark, data):
    turns = {}
    for c, n, role, text in table(data, "conversations", "conv_id, turn, role, text"):
        turns.setdefault(c, []).append((n, role or "", text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in chat.op6_chat_format(spark, data).collect()}
    assert set(got) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(rows) and r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in rows))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] > sum(len(t) for *_, t in rows)


@pytest.mark.parametrize("module, query, label, folds, out, recall", [(toxicity, "op8_toxicity", "toxic", 3, 1, 0.6), (quality, "op10_quality", "quality", 4, 2, 0.9)])
def test_classifiers_on_held_out_rows(spark, data, module, query, label, folds, out, recall):
    data = data.replace("sf0.001", "sf0.01")
    truth = dict(table(data, "labels", f"doc_id, {label}"))
    rows = getattr(module, query)(spark, data).collect()
    assert len(rows) == len(table(data, "documents", "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    told = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = sum(p and y for p, y in told)
    assert hit >= recall * sum(y for _, y in told) and hit >= 0.9 * sum(p for p, _ in told)


PARTS = [
    '<aside>note {x}<p>of words</p></aside>', '<div class="ad">buy {x} now</div>', '<section id="comments"><p>reader {x} said</p><p>more</p></section>',
    "<form><p>name {x}</p><input><button>go</button></form>", "<script>var a = '<p>{x}</p>';</script>", "<!-- {x} <p> -->", '<ul class="share-links"><li>share {x}<li>mail</ul>',
    '<div class="cookie-notice">we use {x}<p>ok</p></div>', '<p class="share">share {x}', '<nav><a href="/">menu {x}</a></nav>',
]
BLOCKS = ["<p>{x} a &lt; b &amp;amp; c</p>", "<p>{x} with <b>bold <a href='u?a>b'>link</a></b> end", "<h2>{x} head</h2>", "<ul><li>{x} one<li>two</ul>", "<p>if {x} < 5 then 3 > 2</p>", "<table><tr><td>{x} cell<td>next</table>", "<blockquote>{x} said\n so</blockquote>", '<div data-id="ad-3" class="share-enabled">{x} kept</div>']
TEXTS = ["{x} a < b &amp; c", "{x} with bold link end", "{x} head", "{x} one\ntwo", "if {x} < 5 then 3 > 2", "{x} cell\nnext", "{x} said so", "{x} kept"]


@pytest.mark.parametrize("weights", [html_text.FIXED, {"tag": -3.0, "word": 0.5, "<li": -9.0, "/li": -9.0, "<a": -9.0}])
def test_articles_come_back_whole(weights):
    """Left-out elements at every place of made-up articles, with end tags or without."""
    rng = random.Random(5)
    for n in range(300):
        body, want = [], []
        for k in range(rng.randint(1, 7)):
            while rng.random() < 0.5:
                body.append(rng.choice(PARTS).format(x=" ".join(["gone"] * rng.choice([1, 5, 200]))))
            i, x = rng.randrange(len(BLOCKS)), f"w{n} " + " ".join(f"t{k}" for _ in range(rng.choice([1, 4, 60])))
            body.append(BLOCKS[i].format(x=x))
            want.append(TEXTS[i].format(x=x))
        page = f'<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li>menu<li>more</ul></nav><article>{"".join(body)}</article><p>beside it</p><footer>foot</footer></body></html>'
        assert html_text.extract(page, weights) == "\n".join(want), page
    # beyond the levels that are followed; so many tags part the texts
    assert html_text.extract("<b>" * 3000 + "<p>deep" + "<div>" * 3000 + "text", weights).startswith("deep")


CLASH = ("_id", "_key", "_gone", "_cut", "_rank", "_src", "_size", "c_src", "copies", "score", "_spans", "_items", "_n_words", "n_lines", "n_removed", "_row", "CLASS")


def test_names_that_operators_use(spark):
    rows = [(i, f"line one of {i}\na line that is common to all", f"s{i % 9}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "line one")], "item_id long, text string")
    names = lambda df: sorted(c.lower() for c in df.columns)
    mine = sorted(c.lower() for c in docs.columns)
    stay = ngram_join.representatives(docs)
    assert names(stay) == mine and stay.count() == 30
    for out in (line_dedup.clean(docs), decontaminate.annotate(docs, bench), mixing.mixed(docs), toxicity.score(docs, labels)):
        assert names(out) == mine  # what has a result's name is replaced
        row = out.collect()[0]
        assert row["c_src"] == CLASH.index("c_src") and row["CLASS"] == CLASH.index("CLASS")


def test_sets_of_one_class_get_classes_of_their_own(spark):
    rows = spark.createDataFrame([(1, 5, 7), (1, 5, 7), (1, 5, 8), (1, 6, 7), (0, 0, 0)], "n long, class long, check long")
    renamed = ngram_join.clashes(rows)
    assert set(renamed) == {(5, 7), (5, 8)} and len({*renamed.values(), 6}) == 3
    assert ngram_join.Namer({ngram_join.digests(bytes(range(16))): 42})(bytes(range(16))) == 42


def test_repeats_are_counted_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 64)
    rng = np.random.default_rng(1)
    counts, repeats = Counter(), ngram_join.Repeats()
    for k in range(300):
        s = np.unique(np.concatenate([rng.integers(100, 1 << 40, 10), [1] if k % 2 else [2, 3]]).astype(np.uint64))
        counts.update(s.tolist())
        repeats.add(s)
    token, n = repeats.often(100)
    assert {1, 2, 3} <= set(token.tolist()) and all(x <= counts[t] for t, x in zip(token.tolist(), n.tolist()))


@pytest.mark.parametrize("call", [0, 1, 2])
def test_pairs_of_one_class_are_dealt_in_blocks(spark, monkeypatch, call):
    monkeypatch.setattr(ngram_join, "PARTNERS", 4)
    rng = random.Random(call)
    sets = {i: sorted(rng.sample(range(40), 20) if call else range(i % 3, 20)) for i in range(30)}
    pairs = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 20)]
    values = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in sets.items()], "class long, value binary")
    got = ngram_join.compared(spark.createDataFrame(pairs, "a long, b long"), values, ngram_join._intersect)
    same = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})
    assert sorted(map(tuple, got.collect())) == sorted(p for p in pairs if same(*p))
