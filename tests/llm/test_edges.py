"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from colloquy.llm.decontamination import find_contamination
from colloquy.llm.language_id import identify
from colloquy.llm.line_dedup import dedup_lines
from colloquy.llm.mixing import mix_sources
from colloquy.llm.ngram_join import join_similar, keep_first
from colloquy.llm.suffix_dedup import dedup_substrings
from colloquy.llm.token_counts import count_tokens
from colloquy.llm.toxicity import judge
from colloquy.llm.url_filter import URL_RULES, filter_urls

CLASHING = "doc_id long, text string, lang string, source string, _k long, node long, size string, n long, g string, state string, score string, hit string"


def odd_rows():
    long = "word " * 40_000
    rows = [(None, None), (None, "id without"), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "other text"), (4, long), (5, long), (6, "\n\n\n\n"), (7, "\x00 ퟿ 𝄞"), (8, "one line\n" * 5)]
    return [(d, t, None if i % 3 else "en", None if i % 4 else "web", i, i, "s", i, "g", "x", "y", "z") for i, (d, t) in enumerate(rows)]


def with_labels(docs):
    return judge(docs, docs.sparkSession.createDataFrame([(3, 1), (3, 0), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int"))


def against_items(docs):
    return find_contamination(docs, docs.sparkSession.createDataFrame([(1, "a b c"), (None, "one line"), (2, None)], "item_id long, text string"))


OPERATORS = {
    "toxicity": with_labels,
    "token_counts": count_tokens,
    "line_dedup": dedup_lines,
    "decontamination": against_items,
    "url_filter": lambda docs: filter_urls(docs, URL_RULES, url="text"),
    "language_id": identify,
    "mixing": mix_sources,
    "ngram_join": join_similar,
    "suffix_dedup": dedup_substrings,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_all_come_out(spark, name):
    rows = odd_rows()
    done = OPERATORS[name](spark.createDataFrame(rows, CLASHING)).collect()
    assert sorted(str(r.doc_id) if "doc_id" in r else "" for r in done) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], CLASHING)).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "token_counts", "line_dedup", "decontamination", "url_filter", "language_id"])
def test_other_columns_pass_through(spark, name):
    docs = spark.createDataFrame(odd_rows(), CLASHING)
    done = OPERATORS[name](docs)
    own = [c for c in docs.columns if c not in ("score", "text")]
    key = lambda r: str(r)
    assert sorted(map(key, done.select(own).collect())) == sorted(map(key, docs.select(own).collect()))


def test_repeated_rows_are_treated_alike(spark):
    docs = spark.createDataFrame(odd_rows(), CLASHING)
    done = [(r.class_id, r.n_links) for r in join_similar(docs).filter("doc_id = 3").collect()]
    assert len(done) == 3 and len(set(done)) == 1  # too few words: the row and its copy are one, the other text is alone
    lines = dedup_lines(docs).filter("doc_id = 8").first()
    assert (lines.n_lines, lines.n_removed) == (6, 4)


def test_long_copies_are_one_class_and_one_stays(spark):
    docs = spark.createDataFrame(odd_rows(), CLASHING)
    done = {r.doc_id: (r.class_id, r.n_links) for r in join_similar(docs).filter("doc_id IN (4, 5)").collect()}
    assert done == {4: (4, 1), 5: (4, 1)}
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id = 5").isEmpty() and kept.filter("doc_id = 4").count() == 1
    assert kept.filter("text IS NULL").count() == 2


def test_decontamination_of_odd_items(spark):
    done = {(r.doc_id, r.text): r for r in against_items(spark.createDataFrame(odd_rows(), CLASHING)).collect()}
    assert done[(3, "a b c")].contaminated and done[(3, "a b c")].item_ids == ["1"]
    assert not done[(3, "other text")].contaminated and done[(None, None)].n_words == 0


def test_nothing_to_compare_with(spark):
    docs = spark.createDataFrame(odd_rows(), CLASHING)
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, none).filter("contaminated").isEmpty()
    assert identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").isEmpty()
    assert filter_urls(docs, [], url="text").filter("verdict <> 'allow' OR rule IS NOT NULL").isEmpty()


def test_columns_that_cannot_be_compared_or_have_odd_names_pass_through(spark):
    from pyspark.sql import functions as F

    from colloquy.llm.ngram_join import keep_first
    from colloquy.llm.suffix_dedup import dedup_substrings

    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (1, long), (2, long), (None, None), (3, "")], "doc_id long, text string")
    docs = docs.withColumns({"m": F.create_map(F.lit("a"), F.col("doc_id")), "odd one": F.struct(F.lit(1).alias("a b"), F.col("doc_id").alias("c.d"))})
    kept = keep_first(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, (r["m"] or {}).get("a"), r["odd one"]["a b"]) for r in kept.collect()) == [(0, None, 1), (1, 1, 1), (3, 3, 1)]
    done = dedup_substrings(docs).collect()
    assert len(done) == 5 and {r["odd one"]["a b"] for r in done} == {1}


def test_kept_texts_are_shuffled_once(spark, capsys):
    rows = [(1, "a b c d e f", {"x": 1}), (1, "a b c d e f", {"x": 1}), (None, "a b c d e f", None), (None, "g h", None), (2, None, None)]
    kept = keep_first(spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>"))
    kept.explain(mode="formatted")
    sections = capsys.readouterr().out.split("\n\n")
    assert len([s for s in sections if ") Exchange\n" in s and ("text#" in s or "Ordering#" in s)]) == 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == [(False, 2, ""), (True, 0, "a b c d e f"), (True, 0, "g h")]
