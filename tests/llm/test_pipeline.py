"""The corpus pipeline on a small corpus, stage by stage against brute force."""

import random

import pytest

import corpus_pipeline as cp

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["tala rami sono belu kire mano vetu", "schorz kracht stumpf grenz pflock wurst zwerg"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda lang, n: " ".join(rng.choice(NAMES[lang].split()) + str(rng.randrange(40)) for _ in range(n))
    items = [(i, say(0, 30)) for i in range(4)]
    block = "\n".join(say(0, 9) for _ in range(3))
    texts = [(say(i % 2, 60), i % 2) for i in range(120)]
    texts += [(texts[i][0], i % 2) for i in range(6)]
    texts += [(texts[i][0].replace(" ", " ", 1) + " extra", i % 2) for i in range(6, 12)]
    texts += [(say(0, 30) + "\n" + block + "\n" + say(0, 30), 0) for _ in range(5)]
    texts += [(say(0, 20) + " " + items[i][1] + " " + say(0, 20), 0) for i in range(4)]
    rows = [(i, t, ["aa", "bb"][lang], rng.choice(["web", "news", None]), len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [(500, None, "aa", "web", None), (501, "?? 42", None, "web", 5), (502, "", None, None, 0)]
    place = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, rows, items


def test_stages(spark, corpus):
    place, rows, items = corpus
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing"]
    docs, made = spark.read.parquet(f"{place}/documents.parquet"), []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, place)
        if i < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        made.append(sorted(map(tuple, out.collect()), key=lambda r: r[0]))
        docs = spark.createDataFrame(made[-1], out.schema)

    known, lined, single, clean, mixed = made
    assert [r[0] for r in known] == [r[0] for r in rows if r[0] < 500]
    want = [(d, t) for d, t, gone in brute.dedup_lines([(r[0], r[1]) for r in known]) if not gone or t.strip()]
    assert [(r[0], r[1]) for r in lined] == want and all(r[4] == len(r[1]) for r in lined)
    classes = brute.similar([(r[0], r[1]) for r in lined])
    assert {r[0] for r in single} == {c for c, _ in classes.values()}
    bad = {d for d, (n, hit, _) in brute.contamination([(r[0], r[1]) for r in single], items).items() if hit and 20 * hit >= n}
    assert bad and {r[0] for r in clean} == {r[0] for r in single} - bad
    assert {r[0] for r in mixed} <= {r[0] for r in clean} and mixed
    sizes = {r[0]: len(r[1].split()) for r in clean}
    assert all(r[-2] == r[-3] * sizes[r[0]] and 1 <= r[-3] <= 3 for r in mixed)


def test_run_applies_all_stages(spark, corpus):
    out = cp.run(spark, corpus[0])
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < out.count() <= 120


def test_empty_corpus(spark, corpus, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_a_second_run_leaves_the_first_result_readable(spark, tmp_path):
    import corpus_pipeline

    first = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n = first.count()
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert first.count() == n and first.select("text").collect()
