"""Operators that learn or approximate: held-out accuracy, recall, tolerance."""

import itertools
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import language_id, mixing, neighbours, toxicity
from colloquy.llm.queries import op6_neighbours

RNG = random.Random(8)
LANGUAGES = {
    "aa": ["tala", "rami", "sono", "belu", "kire", "mano", "vetu"],
    "bb": ["schorz", "kracht", "stumpf", "grenz", "pflock", "wurst", "zwerg"],
    "cc": ["łąkę", "źdźbło", "chrząszcz", "świet", "żółw", "dąbrów", "piąty"],
}


def sentence(lang, n):
    return " ".join(RNG.choice(LANGUAGES[lang]) + RNG.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def speeches(spark):
    rows = [(i, sentence(lang, RNG.randint(2, 40)), lang) for i, lang in enumerate(list(LANGUAGES) * 60)]
    rows += [(900, "12345 !!", None), (901, None, "aa"), (902, "", None), (903, sentence("bb", 9), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_held_out_texts(speeches):
    done = language_id.identify(speeches).collect()
    held = [r for r in done if r.held_out and r.doc_id < 900]
    assert len(held) > 20 and all(r.lang_pred == r.lang for r in held)
    by_id = {r.doc_id: r for r in done}
    for d in (900, 901, 902):
        assert (by_id[d].lang_pred, by_id[d].score, by_id[d].rejected) == ("und", 0.0, True)
    assert by_id[903].lang_pred == "bb" and 0 <= by_id[903].score <= 1 and not by_id[903].rejected


def test_language_rejects_what_is_far_from_all(spark, speeches):
    far = spark.createDataFrame([(950, "漢字仮名交文 " * 20, None)], speeches.schema)
    done = {r.doc_id: r for r in language_id.identify(speeches.union(far)).collect()}
    assert done[950].rejected


def test_language_rejects_long_texts_of_other_scripts(spark, speeches):
    rng = random.Random(3)
    far = [(960 + i, "".join(chr(rng.randrange(first, first + 30)) for _ in range(4000)), None) for i, first in enumerate((0x430, 0x5D0, 0x4E00, 0x3B1))]
    done = {r.doc_id: r for r in language_id.identify(speeches.union(spark.createDataFrame(far, speeches.schema))).collect()}
    assert all(done[d].rejected for d, _, _ in far)
    assert not any(r.rejected for d, r in done.items() if d < 900)


def test_language_equals_a_plain_version(speeches):
    rows = [(r.doc_id, r.text, r.lang) for r in speeches.collect()]
    train = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] and r[2]), key=lambda r: r[0])

    def grams(text):
        codes = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        codes = [32, *(c for i, c in enumerate(codes) if c != 32 or i == 0 or codes[i - 1] != 32), 32]
        counts, m = Counter(), [2654435761, 2246822519, 3266489917]
        for i in range(len(codes)):
            h = 0
            for n in range(min(3, len(codes) - i)):
                h = ((h ^ codes[i + n]) * m[n]) % 2**32
                h ^= h >> 15
                counts[(h * m[0]) % 2**32 >> 20] += 1
        return counts

    df = Counter(g for _, t, _ in train for g in grams(t))
    weigh = lambda c: {g: math.sqrt(n) * (math.log((1 + len(train)) / (1 + df[g])) + 0.1) for g, n in c.items()}
    model = language_id.fit(speeches.filter(language_id.fold(F.col("doc_id"), 4) != 2))
    for _, text, _ in rows:
        if text and any(map(str.isalpha, text)):
            v = weigh(grams(text))
            norm = math.sqrt(sum(x * x for x in v.values()))
            cosines = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in model.centres]
            lang, score, _ = model.predict(text)
            assert score == pytest.approx(max(cosines), abs=1e-4)
            assert lang in {model.languages[i] for i, c in enumerate(cosines) if c > max(cosines) - 1e-4}


def test_language_never_learns_from_held_out_rows(speeches):
    relabelled = speeches.withColumn("lang", F.when(language_id.fold(F.col("doc_id"), 4) == 2, F.lit("zz")).otherwise(F.col("lang")))
    key = lambda r: (r.doc_id, r.lang_pred, r.score)
    assert sorted(map(key, language_id.identify(speeches).collect())) == sorted(map(key, language_id.identify(relabelled).collect()))


CLEAN = ["garden", "window", "letters", "morning", "planets", "village", "harvest", "silence", "market", "bridges"]
FOUL = ["blighter", "scumbags", "wretches"]


def foul(word, kind):
    if kind == 1:
        return word.replace("e", "3").replace("i", "1").replace("a", "4")
    if kind == 2:
        return " ".join(word)
    if kind == 3:
        return "".join(c * 3 if c in "aeiou" else c for c in word)
    return word


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(500):
        w = [rng.choice(CLEAN) for _ in range(rng.randint(5, 30))]
        toxic = i % 3 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), foul(rng.choice(FOUL), rng.choice([0, 0, 1, 2, 3])))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(900, None), (901, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_documents(judged):
    docs, labels = judged
    done = toxicity.judge(docs, labels)
    rows = {r.doc_id: r for r in done.collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id < 900]
    assert len(held) > 50
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert rows[900].score == rows[901].score < 0.5


def test_toxicity_never_learns_from_held_out_labels(judged):
    docs, labels = judged
    turned = labels.withColumn("toxic", F.when(language_id.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda r: (r.doc_id, r.score)
    assert sorted(map(key, toxicity.judge(docs, labels).collect())) == sorted(map(key, toxicity.judge(docs, turned).collect()))


def test_viterbi_restores_what_was_hidden(judged):
    plain = judged[0].sparkSession.createDataFrame([(-1, " ".join(FOUL * 200))], judged[0].schema)
    decoder = toxicity.Decoder(toxicity.character_model(judged[0].union(plain)))
    for word in FOUL:
        for kind in (1, 2, 3):
            assert decoder.decode(foul(word, kind)) == word
    assert decoder.restored("plain words only") == []


@pytest.fixture(scope="module")
def characters(judged):
    plain = judged[0].sparkSession.createDataFrame([(-1, " ".join(FOUL * 200))], judged[0].schema)
    return toxicity.character_model(judged[0].union(plain))


@pytest.mark.parametrize("segment", ["w3", "s$c", "bb", "l1gh", "a.b", "w r e", "$$um", "gg4r", "+*t", "é0x"])
def test_viterbi_finds_the_best_of_all_paths(characters, segment):
    decoder = toxicity.Decoder(characters)

    def worth(letters, costs):
        s = [0, 0, *(0 if c == " " else decoder.index.get(c, toxicity.SYMBOLS - 1) for c in letters), 0]
        steps = list(zip(s, s[1:], s[2:]))
        return sum(costs) + characters[steps[-1]] + sum(characters[a, b, c] for a, b, c in steps[:-1] if c or b)

    ways = [([c for c, _ in path if c], [cost for _, cost in path]) for path in itertools.product(*decoder.options(segment))]
    best = max(worth(*w) for w in ways)
    assert best == pytest.approx(max(worth(*w) for w in ways if "".join(w[0]) == decoder.decode(segment)))


def test_long_segments_are_decoded_in_blocks(characters):
    long = "wr3tches" * 3000
    restored = toxicity.Decoder(characters).decode(long)
    assert len(restored) >= 0.9 * len(long) and restored.count("wretches") > 2900
    few = toxicity.Decoder(characters, ["=wretches", "wretc"])
    assert "wretc" in toxicity.features(few, "x" * 2_000_000 + " wr3tches")


HIDDEN = ["wrretches", "wrettches", "w,r,e,t,c,h,e,s", "w-r.e-t.c-h.e-s", "wretche$", "wr etches", "wre-tches", "w\tr\te\tt\tc\th\te\ts", "w\nr e  t c h e s", "wretch es", "w retches"]


@pytest.mark.parametrize("hidden", HIDDEN)
def test_features_of_a_hidden_word(judged, hidden):
    plain = judged[0].sparkSession.createDataFrame([(-1, " ".join(FOUL * 200))], judged[0].schema)
    model = toxicity.character_model(judged[0].union(plain))
    decoder = toxicity.Decoder(model)
    for text in (hidden, f"garden {hidden} bridges"):
        assert {"=wretches", "wretc"} <= toxicity.features(decoder, text), text
        few = ["=wretches", "wretc", "bridg", "sscu"]
        assert toxicity.features(toxicity.Decoder(model, few), text) & set(few) == toxicity.features(decoder, text) & set(few)


def test_toxicity_without_both_labels(judged, spark):
    docs, labels = judged
    assert {r.score for r in toxicity.judge(docs, labels.filter("toxic = 0")).collect()} == {0.5}
    assert toxicity.judge(docs.limit(0), labels).collect() == []


def brute_nearest(ids, v, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    v = centres[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    ids = rng.permutation(3000)
    rows = [(int(i), [float(np.float32(x)) for x in row]) for i, row in zip(ids, v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    done = neighbours.nearest(table, F.col("vec_id") % 50 == 0, list_size=64).collect()
    want = brute_nearest(ids, np.array([r[1] for r in rows]))
    found = {}
    for r in done:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert found.keys() == want.keys()
    hits = sum(len({x[0] for x in want[q]} & {x[0] for x in found[q].values()}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    u = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}
    for q, ranked in found.items():
        assert sorted(ranked) == [1, 2, 3, 4, 5]
        order = [(-s, i) for _, (i, s) in sorted(ranked.items())]
        assert order == sorted(order)
        assert all(abs(s - u[q] @ u[i]) < 1e-12 for i, s in ranked.values())


@pytest.mark.skipif(not Path("/root/testdata/sf0.1/embeddings.parquet").exists(), reason="the test tables are not here")
def test_neighbours_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [r for r in table.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    want = brute_nearest(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    found = {}
    for r in op6_neighbours(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len({x[0] for x in want[q]} & found[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_neighbours_in_shards_and_with_other_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x", i, 0.5, 3) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, asked long, score double, shard int")
    want = brute_nearest(np.arange(300), np.array([r[1] for r in rows]))
    # shards and readers of a few rows each, a beam that has to widen, and everything within reach
    done = neighbours.nearest(table, F.col("vec_id") % 50 == 0, list_size=8, list_limit=5, query_limit=2, beam=2, reach=100.0).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in done} == {(q, i + 1, v) for q, many in want.items() for i, (v, _) in enumerate(many)}


def test_neighbours_ties_copies_and_broken_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(100, [0.0, 0.0]), (150, None), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, []), (350, [1.0, None]), (None, [1.0, 0.0]), (400, [0.0, 2.0])]
    done = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in sorted(done, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 400: [0, 1, 2, 3, 4]}
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(3000)]
    done = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total, by = sum(r.size for r in done), {}
    for r in done:
        assert r.size == rows[r.doc_id][1].count("w") and 0 <= r.taken <= 3 * r.size
        by.setdefault(rows[r.doc_id][2], []).append(r)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(total)
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and rs[0].target <= 3 * rs[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 60
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.taken) for r in done} == {(r.doc_id, r.taken) for r in again}


def test_mix_shares_what_a_full_source_leaves(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 10, "b"), (3, "w " * 180, "c")]
    done = {r.doc_id: r.target for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert done == pytest.approx({1: 30.0, 2: 30.0, 3: 140.0})


def test_larger_budgets_nest(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [{r.doc_id for r in mixing.mix_sources(docs, weights=(1, w)).filter("source_size > 0 AND copies > 0").collect() if r.doc_id % 2} for w in (0.2, 0.5)]
    assert taken[0] < taken[1]


def test_signs_at_the_beginning_of_a_word_are_letters(spark):
    """In clean documents a word whose first letter is a sign is flagged as often as the plain word is."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    score = model.scorer()
    clean = [r["text"] for r in docs.join(labels.filter("toxic = 0 AND quality = 1"), "doc_id").orderBy("doc_id").select("text").limit(200).collect()]
    clean = [t for t in clean if len(t.split()) > 20 and score(t) < 0.5][:40]
    flagged = lambda word: sum(score(" ".join([*t.split()[:10], word, *t.split()[10:]])) >= 0.5 for t in clean)
    for plain, hidden in (("idiot", ("1diot", "1d10t", "!d!ot", "(1d10t)")), ("trash", ("7rash", "7r45h"))):
        assert flagged(plain) >= 10
        assert [h for h in hidden if flagged(h) < flagged(plain) - 2] == []
