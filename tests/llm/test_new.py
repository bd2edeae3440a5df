"""Byte-level encoding, filter audits and hard negatives against plain versions."""

import itertools
import random
import re
from array import array
from fractions import Fraction

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from colloquy.llm.byte_bpe import Vocabulary, blocks, decode_ids, encode_texts, last_joins, pattern, read_ranks, round_trip
from colloquy.llm.filter_audit import RemovalPolynomial, audit_filters, mask_counts
from colloquy.llm.hard_negatives import mine


@pytest.fixture(scope="module")
def tokens():
    return read_ranks()


@pytest.fixture(scope="module")
def plain(tokens):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n", "a", "Hello world, it's 1984!", "don't  stop\n\n  now \t ", "x" * 3000, "=" * 501, "ab" * 400 + "a", "aab" * 40 + "aaaa", "日本語のテキスト " * 30, "naïve Ünïcödé ſ ß",
    "a b c　d\u0085e᠎f", "𝔘𝔫𝔦 😀👩‍👩‍👧 \U0001df00\U00031350 ࢠ ٣٤ ⅷ ²", "<|endoftext|>", "'s 'T 'll're", "\x00\x01\x7f", "word " * 2500 + "   " * 2000 + "end", "long" * 3000 + " tail",
]


def test_bpe_encodes_as_the_tokenizer_library_and_decodes_what_went_in(spark, plain):
    rng = random.Random(3)
    alphabet = "aeiouxyz 0159.,-_'\"\n\té漢😀 "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(150)] + TEXTS[:8]
    docs = spark.createDataFrame([(i, t, "kept", "replaced") for i, t in enumerate(texts)], "doc_id long, text string, decoded string, token_ids string")
    for dictionary in (0, 7, 1000):
        done = round_trip(docs, dictionary=dictionary).collect()
        assert len(done) == len(texts)
        for r in done:
            assert r["token_ids"] == plain.encode_ordinary(r["text"] or ""), (dictionary, r["text"])
            assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_pattern_has_the_librarys_letters_numbers_and_white_space(spark):
    cut_at = pattern(spark)
    theirs = tiktoken.Encoding("cut", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = [chr(c) for c in range(0x20, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}1{c}.{c} " for c in every)
    own = spark.createDataFrame([(text,)], "text string").select(F.explode(F.regexp_extract_all("text", F.lit(cut_at), F.lit(0)))).collect()
    assert "".join(r[0] for r in own) == text == theirs.decode(theirs.encode_ordinary(text))
    import regex  # the same rules with its own tables, on what those know

    assert [r[0] for r in own][:5000] == regex.findall(public_tokenizers.PATTERN, text)[:5000]


def test_bpe_blocks_end_before_white_space(spark):
    text = "ab cd  " * 3000 + "x" * 9000 + " " * 9000
    parts = [r[0] for r in spark.createDataFrame([(text,)], "text string").select(F.explode(blocks(F.col("text")))).collect()]
    assert "".join(parts) == text and len(parts) > 4
    assert all(re.search(r"\S$", p) for p in parts[:-1]) and all(re.match(r"\s", p) for p in parts[1:])


def test_bpe_keeps_other_columns_and_passes_over_unknown_ids(spark, tokens):
    v = Vocabulary(tokens)
    docs = spark.createDataFrame([], "doc_id long, text string, n long")
    assert encode_texts(docs, vocabulary=v, dictionary=5).columns == ["doc_id", "text", "n", "token_ids"]
    ids = spark.createDataFrame([([15496, 10**6, 995],), (None,), ([],)], "token_ids array<int>")
    assert [bytes(r["decoded"]) for r in decode_ids(ids, vocabulary=v).collect()] == [b"Hello world", b"", b""]


def test_bpe_refuses_ranks_that_do_not_rise(tmp_path):
    import base64

    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4}
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    with pytest.raises(ValueError, match="rising rank"):
        last_joins(read_ranks(str(path)))


def test_bpe_reads_the_table_once_and_keeps_no_dictionary_of_it_in_the_plan(spark, tokens):
    reads = spark.sparkContext.accumulator(0)

    def row(i):
        reads.add(1)
        return i, f"zq{i}xv same words {'and ' * 50}"

    texts = spark.createDataFrame(spark.sparkContext.parallelize(range(500), 3).map(row), "doc_id long, text string")
    sizes = []
    for docs in (texts, spark.createDataFrame([(0, "a b")], "doc_id long, text string")):
        encoded = encode_texts(docs, vocabulary=Vocabulary(tokens), dictionary=1000)
        assert encoded.select("token_ids").collect()
        sizes.append(len(encoded._jdf.queryExecution().optimizedPlan().toString()))
    assert reads.value == 500
    assert abs(sizes[0] - sizes[1]) < 1000


def test_bpe_folds_pieces_of_every_length_as_the_tokenizer_library(spark, tokens, plain):
    rng = random.Random(8)
    words = [bytes(rng.choice(b"aeinorst xyz0\xc3\xa9\xff") for _ in range(n)) for n in range(1, 140) for _ in range(20)]
    words += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    words += [part * n for part in (b"x", b"ab", b"aab", b"=") for n in (1, 2, 3, 31, 32, 33, 63, 64, 65, 66, 500)]
    joins = Vocabulary(tokens).joins
    for word, ids in zip(words, joins.encode(words), strict=True):
        assert array("i", ids).tolist() == plain._core_bpe.encode_single_piece(word), word
    assert joins.encode([b""]) == [b""] and joins.encode([]) == []


def test_bpe_takes_what_is_no_utf8_as_replacement_characters(spark, plain):
    docs = spark.createDataFrame([(1, bytearray(b"ab \xff\xfe cd\xc3")), (2, bytearray(b"fine"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw AS string) AS text")
    for r in encode_texts(docs).drop("text").collect():
        assert plain.decode(r["token_ids"]) == {1: "ab \ufffd\ufffd cd\ufffd", 2: "fine"}[r["doc_id"]]


def failed(text, is_copy):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return "".join(f for f, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), is_copy)) if bad)


def test_audit_equals_applying_all_orders(spark):
    rng = random.Random(11)
    words = ["alfa", "BETA", "gamma", "de#ta", "été", "zeta"] + [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choice(words[: rng.choice([6, 96])]) for _ in range(rng.choice([0, 10, 49, 50, 51, 120]))) for _ in range(40)] + [None, "", "AB\x0bcd ef", "x" * 50_000]
    rows = [(i if i % 17 else None, rng.choice(texts), rng.choice([None, "", "a", "b"]), "other") for i in range(160)]
    rows += rows[:9]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n string")
    done = audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    judged = [(source or "", i, failed(text or "", i is not None and i > first[text or ""])) for i, text, source, _ in rows]
    want = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[2]]
                left = [j for j in left if f not in j[2]]
                fails = sum(f in j[2] for j in own)
                want[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(j[2] == f for j in own), sum(j[1] in good for j in gone), sum(j[1] in toxic for j in gone)]
        for f in "ABCDE":
            total = sum(want[part, o, s][1] for p, o, s in want if p == part and o[s - 1] == f)
            for p, o, s in want:
                if p == part and o[s - 1] == f:
                    want[p, o, s].append(total)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in done}
    assert len(done) == len(got) == 600 * len({j[0] for j in judged})
    assert got == want


def test_audit_of_no_rows_and_of_many_copies(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(spark.createDataFrame([], "doc_id long, text string, source string"), labels).count() == 0
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    counts = {r["mask"]: r["n"] for r in mask_counts(docs, labels).collect()}
    assert counts == {0b00001: 1, 0b10001: 899}


def test_removal_polynomial_has_corners_and_rational_shapley_values():
    counts = {0: 5, 1: 7, 3: 2, 7: 1, 6: 4}
    p = RemovalPolynomial(counts, 3)
    for chosen in range(8):
        assert p.corner(chosen) == sum(n for mask, n in counts.items() if mask & chosen)
    assert [p.shapley(i) for i in range(3)] == [7 + Fraction(2, 2) + Fraction(1, 3), Fraction(2, 2) + Fraction(1, 3) + Fraction(4, 2), Fraction(1, 3) + Fraction(4, 2)]
    assert sum(p.shapley(i) for i in range(3)) == p.corner(7)


def plainly(rows, is_anchor, positives=5, negatives=10):
    clean, out = {}, []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or c != c or abs(c) == float("inf") for c in v):
            continue
        x = [int(256 * c // 1) for c in v]
        clean[i] = min(clean.get(i, (x, label)), (x, label))
    for a, (x, label) in clean.items():
        if is_anchor(a):
            scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (y, other) in clean.items() if i != a)
            for s, p, _ in [r for r in scored if r[2] == label][:positives]:
                near = [(n, i) for n, i, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s]
                out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(near[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"shards": 1, "pivots": 2, "seeds": 3}, {"shard_rows": 90, "block_rows": 3, "pivots": 5, "seeds": 8}])
def test_hard_negatives_equal_brute_force(spark, how):
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centre)], rng.randrange(3)) for i in range(400)]
    rows += [(500 + i, [0.5] * 6, i % 3) for i in range(60)]  # one vector many times
    rows += [(700, [], 1), (710, [1.0], 1), (720, None, 1), (730, [1.0, None], 1), (740, [float("nan")] * 6, 1), (750, [float("inf")] * 6, 0), (760, [0.1] * 6, None), (None, [0.3] * 6, 0), (20, [9.0] * 6, 1), (20, [9.0] * 6, 1), (770, [0.0] * 6, 2), (780, [3e5, -2e5, 1.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, mine(df, F.col("vec_id") % 10 == 0, **how).collect()))
    assert got == plainly(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_hard_negatives_of_no_rows_and_no_partners(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(spark.createDataFrame([(0, [1.0], 1)], schema), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [2.0], 1)], schema), F.col("vec_id") % 10 == 0).count() == 0
