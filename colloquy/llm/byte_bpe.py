"""Byte-level byte-pair encoding in Arrow batches, and decoding.

A text is cut into pieces by the tokenizer's pattern, in the JVM; the pieces'
lengths go beside the text to Arrow batches, where its bytes are dealt to the
pieces again. Equal pieces of a batch are one entry of a dictionary, and a fold
over the bytes of all new entries joins neighbours: in every step the pair of
the lowest rank of each piece, the leftmost of equal ones. Pieces of more than
``LONG`` bytes take their pairs from a heap instead.

A task remembers up to ``dictionary`` pieces of at most ``longest`` bytes and
forgets them all when there are more; what is not remembered is folded again. No
text, piece or count goes through the driver or a shuffle, and the table is read once.

A token's own bytes have to be encoded as this token by joins of rising rank;
``read_ranks`` refuses a vocabulary without this property. Unicode letters,
numbers and white space are those of the tiktoken library: what the JVM's tables
lack or have beyond them is added to or taken from the pattern.

Decoding looks up each id's bytes and concatenates them. Ids that the vocabulary
lacks have no bytes.

Defined results: null and empty texts have no tokens; what is no UTF-8 counts as
U+FFFD; repeated rows count alike; an empty table gives no rows; other columns
pass through, but for those of the operator's own names, which are replaced. A
text is cut in blocks of about ``BLOCK`` characters that end before white space,
which no piece crosses.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Ids, with those of bytes that are no tokens, are below this.
ID_LIMIT = 1 << 20
#: Where a pair's first id begins in its key.
PAIR_BITS = 32
#: Pieces of up to so many bytes are folded together, a piece a row.
LONG = 64
#: Entries of such a table at most.
CELLS = 1 << 20
#: So many bytes of texts are encoded at a time, or one text.
BYTES = 1 << 22
BLOCK = 4000


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a rank file by id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def last_joins(tokens: list[bytes]) -> dict[tuple[bytes, bytes], int]:
    """Which two parts each token's own bytes end in before they are the token; checks that joins of rising rank lead there.

    With that property no other two parts ever stand where they make up the token:
    what happens within its bytes is what happens when they are encoded alone.
    """
    ranks, out = {t: i for i, t in enumerate(tokens) if t}, {}
    for token in ranks:
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], len(tokens)), i) for i in range(len(parts) - 1))
            if not last <= rank < len(tokens):
                raise ValueError(f"token {token!r} is not what its bytes are encoded as by joins of rising rank")
            if len(parts) == 2:
                out[parts[0], parts[1]] = rank
            parts[i : i + 2], last = [parts[i] + parts[i + 1]], rank
    return out


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


class Joins:
    """Which id two ids join to, and the fold of pieces; travels to tasks as arrays."""

    def __init__(self, joins: dict[int, int], alone: list[int], n: int):
        self.keys = np.array(sorted(joins), np.int64)  # first id, second id
        self.values = np.array([joins[k] for k in self.keys.tolist()], np.int64)
        self.alone, self.n = np.array(alone, np.int64), n

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ids of the tokens that parts join to, else ``ID_LIMIT``."""
        out = np.full(first.shape, ID_LIMIT)
        if len(self.keys):
            key = first << PAIR_BITS | second
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            np.copyto(out, self.values[at], where=self.keys[at] == key)
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of pieces, each as int32 in a string of bytes."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        start, end = np.searchsorted(sizes[order], [1, LONG + 1])
        while start < end:
            # pieces of about one length, so that little is padding
            width = int(sizes[order[start]]) * 5 // 4 + 1
            rows = order[start : min(start + CELLS // width, int(np.searchsorted(sizes[order], width, side="right")), end)]
            for i, ids in zip(rows.tolist(), self._short([words[i] for i in rows.tolist()], sizes[rows])):
                out[i] = ids
            start += len(rows)
        if end < len(words):
            pairs = dict(zip(self.keys.tolist(), self.values.tolist()))
            for i in order[end:].tolist():
                out[i] = self._bytes_of(np.array(self._long(self.alone[np.frombuffer(words[i], np.uint8)].tolist(), pairs)))
        return out

    def _bytes_of(self, ids: np.ndarray) -> bytes:
        return ids[ids < self.n].astype(np.int32).tobytes()  # bytes that are no tokens have no id

    def _short(self, words: list[bytes], sizes: np.ndarray) -> Iterator[bytes]:
        """A fold: each step joins in every row the pair of the least rank, the leftmost of equal ones."""
        width = int(sizes.max())
        places = np.arange(width)
        held = places < sizes[:, None]
        parts = np.full(held.shape, ID_LIMIT)
        parts[held] = self.alone[np.frombuffer(b"".join(words), np.uint8)]
        goals = np.full(held.shape, ID_LIMIT)  # what a part and its next one join to
        pairs = held[:, 1:]
        goals[:, :-1][pairs] = self.of(parts[:, :-1][pairs], parts[:, 1:][pairs])
        done, left = parts.copy(), np.arange(len(words))
        while True:
            at = goals.argmin(axis=1)
            least = goals[np.arange(len(left)), at]
            go = least < ID_LIMIT
            if not go.all():
                done[left[~go], : parts.shape[1]] = parts[~go]
                done[left[~go], parts.shape[1] :] = ID_LIMIT
                left, parts, goals, at, least = left[go], parts[go], goals[go], at[go], least[go]
            if not len(left):
                break
            rows, places = np.arange(len(left)), places[: parts.shape[1] - 1]
            parts[rows, at] = least
            parts = np.take_along_axis(parts, places + (places > at[:, None]), axis=1)
            goals = np.take_along_axis(goals, places + (places >= at[:, None]), axis=1)
            after, before = at + 1 < len(places), at > 0
            for r, c in ((rows[after], at[after]), (rows[before], at[before] - 1)):
                goals[r, c] = self.of(parts[r, c], parts[r, c + 1])
        kept = done < self.n
        flat = memoryview(done[kept].astype(np.int32).tobytes())
        ends = 4 * np.cumsum(kept.sum(axis=1))
        return (bytes(flat[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))

    def _long(self, parts: list[int], pairs: dict[int, int]) -> list[int]:
        """Joins in a linked list; a heap gives the least rank, the leftmost of equal ones."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        goal = lambda i: pairs.get(parts[i] << PAIR_BITS | parts[after[i]]) if i >= 0 and after[i] < n else None
        heap = [(token, i) for i in range(n) if (token := goal(i)) is not None]
        heapq.heapify(heap)
        while heap:
            token, i = heapq.heappop(heap)
            if parts[i] is None or goal(i) != token:
                continue  # one of the two is part of another token by now
            gone = after[i]
            parts[i], parts[gone], after[i] = token, None, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if (token := goal(at)) is not None:
                    heapq.heappush(heap, (token, at))
        return [part for part in parts if part is not None]


class Vocabulary:
    """A rank file: joined ids by pairs of ids, and a literal of bytes by id."""

    def __init__(self, tokens: list[bytes]):
        self.n = len(tokens)
        if self.n + 256 > ID_LIMIT:
            raise ValueError(f"a vocabulary of more than {ID_LIMIT - 256} tokens")
        ids = {t: i for i, t in enumerate(tokens) if t}
        # bytes that are no tokens get numbers beyond all ids
        alone = [ids.setdefault(bytes([i]), self.n + i) for i in range(256)]
        self.joins = Joins({ids[a] << PAIR_BITS | ids[b]: joined for (a, b), joined in last_joins(tokens).items()}, alone, self.n)
        self.bytes = _literal([t.decode("latin-1") for t in tokens], "array<string>")

    def decoded(self, ids: Column) -> Column:
        """The bytes of an array of ids, binary."""
        shown = F.array_join(F.transform(ids, lambda i: F.get(self.bytes, i)), "")
        return F.encode(shown, "ISO-8859-1")


def _ranges(points: list[int]) -> str:
    """Inside of a character class with these code points."""
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(rf"\x{{{start:X}}}-\x{{{p:X}}}")
            start = None
    return "".join(out)


def pattern(spark: SparkSession) -> str:
    """The tokenizer's pattern for the JVM, with the letters, numbers and white space of the tiktoken library."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    rows = spark.createDataFrame([(every,)], "every string")
    classes = {}
    for name, own in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        jvm = {"S": r"\x09-\x0D\x20\x{85}\x{A0}\p{Z}"}.get(name, own)
        theirs = tiktoken.Encoding("class", pat_str=own, mergeable_ranks=single, special_tokens={})
        want = set(theirs.decode(theirs.encode_ordinary(every)))
        have = set(rows.select(F.regexp_replace("every", f"[^{jvm}]", "")).first()[0])
        more, less = sorted(map(ord, want - have)), sorted(map(ord, have - want))
        # beyond ASCII, so that common characters are decided by the first part alone
        classes[name] = jvm + (rf"[[\x{{80}}-\x{{10FFFF}}]&&[{_ranges(more)}]]" if more else "") + (f"&&[^{_ranges(less)}]" if less else "")
    letter, number, space = (f"[{classes[c]}]" for c in "LNS")
    # the alternatives of the public pattern, in its order
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{space}{letter}{number}]+|{space}+(?![^{space}])|{space}+"


def blocks(text: Column) -> Column:
    """A text in blocks that end before white space."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{BLOCK}}}\s*+\S++|.+"), F.lit(0))


def piece_lengths(text: Column, cut_at: str) -> Column:
    """How many bytes each piece of a text has, array<int>; pieces leave nothing out."""
    lengths = lambda block: F.transform(F.regexp_extract_all(block, F.lit(cut_at), F.lit(0)), lambda piece: F.octet_length(piece))
    return F.flatten(F.transform(blocks(text), lengths))


def _encoder(joins: Joins, dictionary: int, longest: int):
    """A function of columns, a text and the lengths of its pieces, to ids."""

    def ids_of(pieces: pa.Array, known: dict[bytes, bytes]) -> pa.ListArray:
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in known]
        known.update(zip(new, joins.encode(new)))
        of = list(map(known.__getitem__, words))
        starts = np.concatenate(([0], np.cumsum([len(ids) // 4 for ids in of]))).astype(np.int32)
        if len(known) > dictionary:
            known.clear()
        else:
            for w in new:
                if len(w) > longest:
                    del known[w]
        return pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(of), np.int32))).take(coded.indices)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[bytes, bytes] = {}
        for texts, lengths in batches:
            texts = texts.cast(pa.large_binary())
            data = texts.buffers()[2]
            # where each text's bytes begin, and its pieces
            begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            at, sizes = lengths.offsets.to_numpy(), lengths.values.to_numpy()
            done, a = [], 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(begins, begins[a] + BYTES, side="right")) - 1)
                places = begins[a] + np.concatenate(([0], np.cumsum(sizes[at[a] : at[b]], dtype=np.int64)))
                if places[-1] != begins[b]:
                    raise ValueError("the pieces are not the whole texts")
                ids = ids_of(pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), data]), known)
                ends = ids.offsets.to_numpy()
                done.append(pa.ListArray.from_arrays(ends[at[a : b + 1] - at[a]], ids.values))
                a = b
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return encoded


def encode_texts(docs: DataFrame, path: str = VOCABULARY, text: str = "text", *, dictionary: int = 200_000, longest: int = 64, vocabulary: Vocabulary | None = None) -> DataFrame:
    """All columns of ``docs`` and token_ids, array<int>."""
    vocabulary = vocabulary or Vocabulary(read_ranks(path))
    encoded = _encoder(vocabulary.joins, dictionary, longest)
    valid = F.make_valid_utf8(F.coalesce(F.col(text), F.lit("")))
    ids = encoded(valid, piece_lengths(valid, pattern(docs.sparkSession)))
    return docs.select(*[c for c in docs.columns if c != "token_ids"], ids.alias("token_ids"))


def decode_ids(encoded: DataFrame, path: str = VOCABULARY, ids: str = "token_ids", *, vocabulary: Vocabulary | None = None) -> DataFrame:
    """All columns of ``encoded`` and decoded, binary."""
    vocabulary = vocabulary or Vocabulary(read_ranks(path))
    return encoded.select(*[c for c in encoded.columns if c != "decoded"], vocabulary.decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))).alias("decoded"))


def round_trip(docs: DataFrame, path: str = VOCABULARY, text: str = "text", **how) -> DataFrame:
    """All columns of ``docs`` and token_ids, decoded."""
    vocabulary = Vocabulary(read_ranks(path))
    return decode_ids(encode_texts(docs, path, text, vocabulary=vocabulary, **how), path, vocabulary=vocabulary)
