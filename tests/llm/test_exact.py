"""Operators with one right answer, against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm.decontamination import find_contamination, proximity
from colloquy.llm.line_dedup import dedup_lines
from colloquy.llm.ngram_join import connected, join_similar, keep_first, least_matches
from colloquy.llm.suffix_dedup import dedup_substrings
from colloquy.llm.token_counts import UNKNOWN, UnigramTrie, count_tokens, piece_scores
from colloquy.llm.url_filter import URL_RULES, DigestArray, digest, filter_urls

from . import brute

VOCABULARY = [a + b for a in ("ba", "de", "ki", "lo", "mu", "sa", "té") for b in ("ra", "ni", "xo", "pe", "ñu")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", ",", "."]) for _ in range(n))


def near_copies(rng):
    rows, d = [], 0
    for _ in range(12):
        base = prose(rng, 120).split(" ")
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(9))
            rows.append((d, " ".join(copy)))
            d += 1
    rows += [(d, "short text"), (d + 1, "Short  TEXT!"), (d + 2, ""), (d + 3, None), (d + 4, "... --")]
    return rows


def test_ngram_join_finds_the_links_of_brute_force(spark):
    rows = near_copies(random.Random(5))
    done = join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in done} == brute.similar(rows)


def test_ngram_join_blocks_give_the_same(spark, monkeypatch):
    from colloquy.llm import ngram_join

    rows = near_copies(random.Random(6)) + [(1000 + i, "one two three four five six seven eight nine ten eleven " * 3 + str(i)) for i in range(30)]
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100)
    done = join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in done} == brute.similar(rows)


def test_keep_first_keeps_one_of_each_class_and_all_columns(spark):
    rows = near_copies(random.Random(7))
    docs = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, class_id string, _k long")
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in brute.similar(rows).values()}


def test_least_matches_grow():
    steps = least_matches(0.8, 1e-6)
    assert [c for c, _ in steps] == sorted(c for c, _ in steps) and all(0 < m < 0.8 * c for c, m in steps)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rng = random.Random(seed)
    passages = [prose(rng, 60) for _ in range(3)]
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(12)] + ["", None, "x", "a" * 700, "ab" * 300]
    texts += [prose(rng, 20) + " " + rng.choice(passages) + " " + prose(rng, 20) for _ in range(8)] + passages[:1] * 3
    rows = list(enumerate(texts))
    done = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in done] == brute.cut_repeats(texts, 200)


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(9)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(60, None), (61, "")]
    done = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.n_removed) for r in done] == brute.dedup_lines(rows)


def test_line_dedup_of_repeated_rows_equals_its_sql(spark):
    import duckdb

    from colloquy.llm.queries import oracle_sql

    texts = ["a\nb\nc\nd", "x\na\nb\nc", "\n\n\n", "", None, "q"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (1, texts[1]), (4, None), (None, texts[1]), (7, texts[0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute("SELECT doc_id, n_lines, n_removed, kept_sha256 FROM (" + oracle_sql()["op3_line_dedup"] + ")").fetchall()
    done = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = done.selectExpr("doc_id", "n_lines", "n_removed", "sha2(coalesce(text, ''), 256)").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {(r.doc_id, r.n_removed) for r in done.collect()} >= {(None, 0), (0, 3), (1, 4), (7, 4)}


def test_components_of_chains_stars_and_hubs(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 299) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (500, 500)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for pair in links for x in pair}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(got) == {x for a, b in links for x in (a, b) if a != b}
    assert len({(root(n), c) for n, c in got.items()}) == len({root(n) for n in got}) == len(set(got.values()))


def test_rounds_of_components_do_not_multiply_the_estimated_size(spark):
    links = [(i * 7 % 41, (i + 1) * 7 % 41) for i in range(40)]
    done = connected(spark.createDataFrame(links, "a long, b long"))
    assert done.count() == 41 and done.select("component").distinct().count() == 1
    assert done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**30


def test_decontamination_beside_a_very_long_word(spark):
    docs = spark.createDataFrame([(1, "x" * 10_000_000 + " alpha beta gamma " + "pad " * 30)], "doc_id long, text string")
    done = find_contamination(docs, spark.createDataFrame([(9, "Alpha beta gamma")], "item_id long, text string")).first()
    assert (done.n_words, done.n_hit, done.item_ids, done.contaminated) == (34, 3, ["9"], True)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 12, 3, 1, 25])] + [(6, None), (7, "?!"), (7, prose(rng, 15))]
    rows = [(i, prose(rng, rng.randint(0, 200))) for i in range(20)]
    for i in range(20, 40):
        w = items[rng.choice([0, 1, 5, 8])][1].split()
        start = rng.randint(0, max(0, len(w) - 13))
        rows.append((i, prose(rng, 50) + " " + " ".join(w[start : start + rng.randint(10, 20)]).upper() + " - " + prose(rng, 50)))
    rows += [(40, None), (41, ""), (42, items[2][1])]
    done = find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.contamination(rows, items)
    for r in done:
        n_words, n_hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.item_ids) == (n_words, n_hit, len(ids), ids)
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)


def test_proximity_takes_words_in_any_order(spark):
    docs = spark.createDataFrame([(1, "gamma x alpha y beta"), (2, "alpha " + "z " * 60 + "beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    found = proximity(docs, spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 9)]


URLS = ["http://a.net/x", "https://EXAMPLE.net/en/1?q#f", "http://sub.example.net/en/", "http://example.net", "http://example.com/de/a", "http://example.com/en", "http://fr.org/fr/", "http://org/fr/x", "http://xorg/fr/", "no scheme", "", None, "ftp://x.net?/", "http://net/", "a://b://c.net/", "http://example.com/de/\nx"]


def test_url_filter_and_its_join_for_large_rule_tables(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    want = [(i, *brute.url_verdict(u, URL_RULES)) for i, u in enumerate(URLS)]
    for most in (100, 2):
        done = filter_urls(pages, URL_RULES, max_rules=most).orderBy("page_id").collect()
        assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in done] == want


def test_url_rules_of_more_path_lengths_than_are_probed(spark):
    far = "/" + "x" * 1100
    rules = [("net" + far[:n], "block" if n % 2 else "allow") for n in range(1, 1101)]
    rules += [("a.long-host.net/x", "allow"), ("long-host.net" + far[:1050] + "y", "block"), ("net" + far[:1060] + "é", "block")]
    urls = [f"http://{host}{far[:n]}{end}" for host in ("net", "a.net", "a.long-host.net") for n in (1, 5, 1023, 1024, 1025, 1026, 1050, 1060, 1099, 1101) for end in ("", "y", "é/z", "?q")]
    want = [brute.url_verdict(u, rules) for u in urls]
    assert {len(w[2] or "") > 1040 for w in want} == {True, False}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (10_000, 2):
        done = filter_urls(pages, rules, max_rules=most).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in done] == want


def test_digest_collisions_are_confirmed_on_the_strings(tmp_path, monkeypatch):
    monkeypatch.setattr("colloquy.llm.url_filter.digest", lambda text: 7)
    (tmp_path / "rules").write_bytes(DigestArray.pack({"net/": "block", "org/": "allow"}))
    import numpy as np

    found = DigestArray(str(tmp_path / "rules")).find(np.array([7, 7, 7], np.uint64), ["org/", "com/", "net/"])
    assert found == {0: "a", 2: "b"}


def test_digest_equals_the_hash_of_a_column(spark):
    row = spark.range(1).selectExpr("xxhash64('example.net/en/') AS h").first()
    assert row.h % 2**64 == digest("example.net/en/")


SCORES = piece_scores(["▁a", "b", "ab", "▁ab", "ba", "▁abba", "é", "c", "▁", "a"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé€𝄞", max_size=9), max_size=30))
def test_trie_counts(words):
    trie = UnigramTrie(SCORES)
    marked = ["▁" + w for w in words] + ["▁" + "ab" * 40 + w for w in words[:4]] + ["▁" + "ab" * 40, "é" * 70]
    trie.grow(marked)
    assert [trie.counts[w] for w in marked] == [brute.unigram_count(w, SCORES, min(SCORES.values()) - UNKNOWN) for w in marked]


def test_token_counts_of_texts(spark):
    docs = spark.createDataFrame([(1, "hello world hello", 5), (2, "", 5), (3, None, 5)], "doc_id long, text string, n_tokens int")
    done = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in count_tokens(docs).collect()}
    assert done[2] == done[3] == (0, 0) and done[1][0] == 3 and done[1][1] >= 3
