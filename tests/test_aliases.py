"""The automaton over a vocabulary against the sequential rule."""

import random
import re
import time

import pytest

from colloquy.operators.aliases import AliasRewriter, alias_pairs, replace_vocabulary


def sequentially(text, pairs):
    for alias, word in pairs:
        text = re.sub(rf"(?<![^\W\d_]){re.escape(alias)}(?![^\W\d_])", lambda m: word, text, flags=re.IGNORECASE)
    return text


def test_rewriter_equals_the_sequential_rule():
    rng = random.Random(8)
    letters = "abé -.1"
    for _ in range(400):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(8)]
        pairs = [(w, rng.choice(words + ["x", ""])) for w in words if w.strip()]
        pairs = sorted([p for p in pairs if p[0].lower() != p[1].lower()], key=lambda p: -len(p[0]))
        text = "".join(rng.choice(letters + "AÉ") for _ in range(60))
        assert AliasRewriter(pairs).rewrite(text) == sequentially(text, pairs), (text, pairs)


@pytest.mark.parametrize(
    ("text", "pairs", "want"),
    [
        ("Hola arich y ariz, bienvenidos.", [("arich", "Aritz"), ("ariz", "Aritz")], "Hola Aritz y Aritz, bienvenidos."),
        ("un blitz itz", [("itz", "Aritz")], "un blitz Aritz"),
        ("ARICH arích", [("arich", "Aritz"), ("ARÍCH", "x")], "Aritz x"),
        ("a b", [("a b", "c d"), ("c", "e"), ("d", "c")], "e c"),
        ("uno dos", [("uno", "[$0] $$1 $&")], "[uno] $1 uno dos"),
        ("", [("a", "b")], ""),
        (None, [("a", "b")], None),
        ("a", [], "a"),
    ],
)
def test_rewriter_cases(text, pairs, want):
    assert AliasRewriter(pairs).rewrite(text) == want


def test_a_long_text_with_many_aliases_is_one_pass():
    pairs = [(f"alias{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", f"word {i}") for i in range(10_000)]
    text = " ".join(a for a, _ in pairs[:300]) + " nothing" * 100_000
    done = AliasRewriter(pairs).rewrite(text)
    assert done.startswith("word 0 word 1 ") and len(done) > 700_000


def test_a_long_text_of_many_different_aliases_costs_its_replacements():
    names = [f"álias{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(4_000)]
    rewriter = AliasRewriter([(n, f"«{i}»") for i, n in enumerate(names)])
    began = time.process_time()
    done = rewriter.rewrite(" ".join(names * 8))
    # 32,000 replacements; with the whole text made anew for each of 4,000 aliases it took minutes
    assert time.process_time() - began < 10
    assert done == " ".join([f"«{i}»" for i in range(4_000)] * 8)


def test_overlaps_of_an_alias_with_itself_go_from_the_left():
    assert AliasRewriter([("a-a", "b")]).rewrite("a-a-a-a a-a-a") == "b-b b-a"
    assert AliasRewriter([("a a", "a"), ("a", "x")]).rewrite("a a a") == "x x"
    assert AliasRewriter([("a", "a b"), ("a", "c"), ("b", "")]).rewrite("a") == "c "


@pytest.mark.parametrize("shard", [1, 2, 100])
def test_vocabulary_table_in_shards(spark, shard):
    terms = [(0, "Aritz", ["arich", " ", None, "ARITZ"]), (1, "la sede", ["sede central", "central"]), (2, "planta", ["sede", "arich"]), (3, None, ["hola"]), (4, "vacío", None)]
    vocabulary = spark.createDataFrame(terms, "ord long, word string, aliases array<string>")
    assert [tuple(r) for r in alias_pairs(vocabulary).collect()] == [("sede central", "la sede"), ("central", "la sede"), ("arich", "Aritz"), ("arich", "planta"), ("sede", "planta")]
    texts = spark.createDataFrame([(1, "hola Arich, la Sede central; central"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in replace_vocabulary(texts, vocabulary, shard=shard).collect()}
    assert got == {1: "hola Aritz, la la planta; la planta", 2: None, 3: ""}
    assert replace_vocabulary(texts, vocabulary.limit(0), shard=shard).count() == 3
