"""URL allow and block rules, probed in a memory-mapped sorted digest array.

A rule is ``host/path``; it fits its host and all subdomains if the url's path
starts with the rule's path, and the longest fitting rule wins (equal lengths:
the longer host, then block). Rules are kept in one file: 64-bit xxhash keys in
order, offsets, and the full strings. Tasks map the file, find the digests of a
url's candidate strings by one vectorised binary search a batch, and compare the
stored string of every hit, so that a digest collision never decides a verdict.

The file reaches executors through ``SparkContext.addFile`` from the shared
checkpoint folder. It holds ``max_rules`` rules and ``MAX_BYTES`` of text at most; a larger rule table is
joined on the candidate strings instead, with the same result. Candidates are made
for the ``LENGTHS`` shortest path lengths; rules with longer paths are joined on the
host and the start of the path that all of them reach, then compared in full.

Defined results: a null url, or one without ``://``, has empty host and path and
fits no rule; what fits no rule gets ``default``; host labels are compared as
written, so a port or a trailing dot fits only rules that name it; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, shared_checkpoints

#: Seed with which Spark's xxhash64 hashes a string column.
SEED = 42
#: A larger rule table is joined; the packed file passes through the driver.
MAX_RULES, MAX_BYTES = 1_000_000, 64 << 20
#: So many path lengths of rules are probed by candidates, the shortest first; longer rules are joined.
LENGTHS = 1024
PROBED = "rule string, verdict string"


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), seed=SEED)


class DigestArray:
    """The file: count, sorted digests, offsets, then verdict letter and rule of each entry."""

    @staticmethod
    def pack(rules: dict[str, str]) -> bytes:
        entries = sorted((digest(rule), verdict[0] + rule) for rule, verdict in rules.items())
        texts = [text.encode() for _, text in entries]
        keys = np.array([key for key, _ in entries], np.uint64)
        offsets = np.cumsum([0, *map(len, texts)]).astype(np.uint64)
        return np.array([len(entries)], np.uint64).tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(texts)

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view(np.uint64)[0])
        self.keys = whole[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = whole[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.texts = whole[16 + 16 * n :]

    def entry(self, i: int) -> str:
        return self.texts[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes().decode()

    def find(self, keys: np.ndarray, candidates: list[str]) -> dict[int, str]:
        """Verdict letter of each candidate (by its place) that is a stored rule."""
        at = np.searchsorted(self.keys, keys)
        found = {}
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys) if len(self.keys) else []):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # entries with equal digests stand side by side
                text = self.entry(j)
                if text[1:] == candidates[i]:
                    found[int(i)] = text[0]
                    break
                j += 1
        return found


@functools.lru_cache(4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def publish(spark: SparkSession, rules: dict[str, str]) -> str:
    """Writes the packed rules to the shared folder and adds the file to the application; its name."""
    packed = DigestArray.pack(rules)
    name = f"url-rules-{hashlib.sha256(packed).hexdigest()[:24]}.bin"
    shared_checkpoints(spark)
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir(), name)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(packed))
    finally:
        out.close()
    if not any(f.endswith(name) for f in sc.listFiles):
        sc.addFile(target.toString())
    return name


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes_of(host: Column) -> Column:
    """Every host suffix at a label."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidates_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix at a label with every path prefix of a length that some rule has."""
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n) if n else F.lit("")) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes_of(host), lambda h: F.transform(starts, lambda p: F.concat(h, p))))


def _probe(name: str, default: str):
    @F.pandas_udf(PROBED)
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rules = _mapped(name)
        for texts, keys in batches:
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            flat = [t for many in texts for t in many]
            found = rules.find(np.concatenate([np.asarray(k, np.int64) for k in keys]).view(np.uint64) if flat else np.empty(0, np.uint64), flat)
            best: dict[int, tuple] = {}
            for i, verdict in found.items():
                rank = (len(flat[i]), len(flat[i].partition("/")[0]), verdict == "b", flat[i])
                best[row[i]] = max(best.get(row[i], rank), rank)
            yield pd.DataFrame({"rule": [best[i][3] if i in best else None for i in range(len(texts))], "verdict": [("block" if best[i][2] else "allow") if i in best else default for i in range(len(texts))]})

    return probe


def _joined(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The way for rule tables above the bound: a shuffle join on the candidate strings."""
    rules = rules.select(F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    keyed = pages.withColumn("_row", F.struct("_host", "_path"))
    wanted = keyed.select("_row", F.explode(F.array_distinct("_candidates")).alias("_rule")).distinct()
    rank = F.struct(F.length("_rule"), F.length(F.substring_index("_rule", "/", 1)), F.col("_verdict") == "block", "_rule", "_verdict")
    best = wanted.join(rules, "_rule").groupBy("_row").agg(F.max(rank).alias("_best"))
    out = keyed.join(best, "_row", "left")
    return out.withColumn("rule", F.col("_best._rule")).withColumn("verdict", F.coalesce("_best._verdict", F.lit(default))).drop("_best", "_row")


def _rank(rule: Column, verdict: Column) -> Column:
    """Order among fitting rules: longer, then the longer host, then block."""
    return F.struct(F.length(rule).alias("n"), F.length(F.substring_index(rule, "/", 1)).alias("n_host"), (verdict == "block").alias("blocked"), rule.alias("rule"), verdict.alias("verdict"))


def _with_long_rules(done: DataFrame, rules: DataFrame, upto: int, default: str) -> DataFrame:
    """``done`` with rule and verdict settled among what was found and the rules whose paths are longer than ``upto``."""
    slash = F.length(F.substring_index("rule", "/", 1))
    long = rules.filter(F.length("rule") - slash > upto).select(F.substring(F.col("rule"), F.lit(1), slash + upto).alias("_key"), F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    row = F.struct("_host", "_path")
    wanted = done.filter(F.length("_path") > upto).select(row.alias("_row")).distinct()
    wanted = wanted.withColumn("_suffix", F.explode(F.array_distinct(suffixes_of(F.col("_row._host")))))
    wanted = wanted.withColumn("_key", F.concat("_suffix", F.substring("_row._path", 1, upto)))
    fits = F.startswith(F.concat("_suffix", "_row._path"), F.col("_rule"))
    best = wanted.join(long, "_key").filter(fits).groupBy("_row").agg(F.max(_rank(F.col("_rule"), F.col("_verdict"))).alias("_best"))
    out = done.withColumn("_row", row).join(best, "_row", "left")
    own = F.when(F.col("rule").isNotNull(), _rank(F.col("rule"), F.col("verdict")))
    return out.withColumn("_best", F.greatest(own, "_best")).withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_best", "_row")


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """All columns of ``pages`` and ``host``, ``path``, ``rule``, ``verdict``.

    ``rules``: pairs of ``host/path`` and ``allow`` or ``block``, or a table
    ``(rule, verdict)``. Columns of those four names in ``pages`` are replaced.
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        rules = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    else:
        best: dict[str, str] = {}
        for rule, verdict in rules:
            best[rule] = max(verdict, best.get(rule, verdict))
        rules = spark.createDataFrame(sorted(best.items()), "rule string, verdict string")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    lengths = [r[0] for r in rules.select(F.length("rule") - F.length(F.substring_index("rule", "/", 1))).distinct().orderBy(F.lit(1)).limit(LENGTHS + 1).collect()]
    lengths, longer = lengths[:LENGTHS], lengths[LENGTHS:]
    sited = pages.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    sited = sited.withColumn("_candidates", candidates_of(F.col("_host"), F.col("_path"), lengths) if lengths else F.array().cast("array<string>"))
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)).alias("bytes")).first()
    if size["n"] > max_rules or size["bytes"] > MAX_BYTES:
        done = _joined(sited, rules, default)
    else:
        name = publish(spark, {r["rule"]: r["verdict"] for r in rules.toLocalIterator()})
        keys = F.transform("_candidates", lambda c: F.xxhash64(c))
        done = sited.withColumn("_hit", _probe(name, default)("_candidates", keys)).select("*", "_hit.rule", "_hit.verdict") if not {"rule", "verdict"} & set(pages.columns) else sited.drop("rule", "verdict").withColumn("_hit", _probe(name, default)("_candidates", keys)).select("*", "_hit.rule", "_hit.verdict")
    if longer:
        done = _with_long_rules(done, rules, lengths[-1], default)
    return done.select(*own, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict")


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
sited AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT s.page_id, s.host, s.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM sited s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY s.page_id, s.host, s.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""
