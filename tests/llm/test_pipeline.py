import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import brute  # noqa: E402


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with toxic texts, boilerplate lines, copies and benchmark passages."""
    rng = random.Random(11)
    d = tmp_path_factory.mktemp("small")
    calm = [f"calm{i}" for i in range(2000)]
    item = [f"bench{i}" for i in range(14)]
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(calm, k=rng.randint(20, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(len(words) // 5):
                words[rng.randrange(len(words))] = "grubvex"
        lines = [" ".join(words[:10]), " ".join(words[10:])]
        if i % 3 == 1:
            lines.insert(1, "shared across many sites")
        if i % 10 == 3:
            lines.append(" ".join(item))
        rows.append((i, "\n".join(lines), "en", f"s{i % 11}", 0))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, r[1] + " end", "en", r[3], 0) for k, r in enumerate(clean[:20])]
    rows += [(2000, None, "en", "s1", 0), (2001, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, " ".join(item)


def test_stages_against_brute_force(spark, small):
    d, rows, item = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for name, stage in pipeline.STAGES:
        out = pipeline.keep(stage(spark, docs, d))
        after = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
        if name != "mix_sources":
            assert out.columns == docs.columns
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if name == "decontaminate" and r["text"] is not None)
        if name == "toxicity":
            gone = {i for i, _, _ in before} - {i for i, _, _ in after}
            assert gone == {i for i, t, _ in before if t and "grubvex" in t}
        elif name == "line_dedup":
            want = brute.line_dedup(before, 8)
            assert sorted((i, t or "") for i, t, _ in after) == sorted((i, t or "") for i, t, _, _ in want)
            assert not any(t and "shared across" in t for _, t, _ in after)
        elif name == "ngram_join":
            comp = brute.components([(i, t) for i, t, _ in before])
            assert sorted(i for i, _, _ in after) == sorted(i for k, (i, _, _) in enumerate(before) if comp[k] == i)
            assert len(after) < len(before)
        elif name == "decontaminate":
            assert all(brute.contaminated(t, [(1, item)])[1] == 0 for _, t, _ in after)
            assert {i for i, _, _ in after} == {i for i, _, _ in before}
        else:
            assert set(out.columns) == {*docs.columns, "copies"}
            words = sum(len((t or "").split()) for _, t, _ in before)
            taken = sum(r["copies"] * len(r["text"].split()) for r in out.collect())
            assert taken == pytest.approx(1.5 * words, rel=0.02)
        docs, before = out, after


def test_run_is_the_stages_in_order(spark, small):
    d, _, _ = small
    out = pipeline.run(spark, d)
    assert "copies" in out.columns and out.count() > 0


def test_line_stage_removes_whole_footers(spark):
    footer = ["first line of the footer", "second line of the footer", "third line of the footer"]
    rng = random.Random(2)
    own = [" ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for _ in range(40)]
    rows = [(i, "\n".join([x, *footer]), "en", f"s{i % 10}", 0) for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in pipeline.drop_lines(spark, df, "").collect()) == sorted(own)
