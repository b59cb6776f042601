"""URL rules by a Bloom filter cascade.

Level 0 encodes the listed keys; level 1 the keys of the corpus that level 0 lets through though they are
not listed; level 2 the listed keys that level 1 lets through, and so on, until a level lets nothing
false through. Over the keys of the corpus, its complete key universe, the cascade answers membership
exactly, and a url is judged by bit tests on its own keys, without a join.

Each level is sized so that what it lets through is about half of what it encodes. All levels together
then follow the number of listed keys, and grow with the corpus only by its logarithm. They are sent to
the executors as arrays up to MOST_WORDS; longer lists than that are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import kernels as K
from tallywright.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: The verdict where no rule fits: a url whose keys are not listed passes.
DEFAULT = "allow"
#: 64-bit words of all levels of a cascade at most, 16 MB: about two million listed keys in a universe of 10**11.
MOST_WORDS = 1 << 21
#: Two keys with equal 128-bit hashes can't be told apart; a cascade this deep means there are such keys.
MOST_LEVELS = 100


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path; both empty for null and urls without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """A url's keys for each (host labels, path length), null where the url is too short for one."""
    wanted = F.from_json(F.lit(str([{"labels": a, "length": b} for a, b in shapes]).replace("'", '"')), "array<struct<labels:int,length:int>>")

    def key(shape: Column) -> Column:
        suffix = F.call_function("substring_index", host, F.lit("."), -shape["labels"])
        whole = (F.size(F.split(suffix, r"\.")) == shape["labels"]) & (F.length(path) >= shape["length"])
        return F.when(whole, F.concat(suffix, F.lit("\n"), F.substring(path, F.lit(1), shape["length"])))

    return F.transform(wanted, key)


def hashes_of(key: Column) -> tuple[Column, Column]:
    """128 bits of a key, from which every level takes its own places."""
    return F.xxhash64(key, F.lit(0)), F.xxhash64(F.lit(1), key)


def _array(column: pa.Array) -> np.ndarray:
    """The hashes as unsigned words; what stands for a null doesn't matter."""
    return np.asarray(column.fill_null(0)).astype(np.int64).view(np.uint64)


@dataclass(frozen=True, eq=False)
class Level:
    """A Bloom filter of ``bits`` bits with ``hashes`` places a key."""

    words: np.ndarray
    bits: int
    hashes: int
    depth: int

    @classmethod
    def sized(cls, inside: int, outside: int, depth: int) -> Level:
        """An empty level for ``inside`` keys that lets about half as many of ``outside`` keys through."""
        hashes = max(1, math.ceil(math.log2(2 * max(1, outside) / max(1, inside))))
        bits = 64 * max(1, math.ceil(1.45 * hashes * inside / 64))
        return cls(np.zeros(bits // 64, np.uint64), bits, hashes, depth)

    def places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """The bit numbers of keys by double hashing, with other hashes at each depth."""
        own = np.uint64((2 * self.depth + 1) * K.BASE % (1 << 64))
        one, two = K.mix(a + own), K.mix(b + own) | np.uint64(1)
        for i in range(self.hashes):
            yield (one + np.uint64(i) * two) % np.uint64(self.bits)

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether all of a key's bits are set."""
        out = np.ones(len(a), bool)
        for p in self.places(a, b):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom(keys: DataFrame, outside: int, depth: int) -> Level | None:
    """A level that encodes the one-column ``keys``, or None if it would be longer than MOST_WORDS.

    Tasks set bits of their own keys and Spark combines them; the driver gets the level's words.
    """
    level = Level.sized(keys.count(), outside, depth)
    if len(level.words) > MOST_WORDS:
        return None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(len(level.words), np.uint64)
        for batch in batches:
            for p in level.places(_array(batch.column("a")), _array(batch.column("b"))):
                np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["w", "v"])

    a, b = hashes_of(F.col(keys.columns[0]))
    spots = keys.select(a.alias("a"), b.alias("b")).mapInArrow(each, "w long, v long")
    got = spots.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    level.words[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return level


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """Levels that tell the keys of ``listed`` from the other keys of ``universe``, without error.

    Both have one column ``key``. What is still confused is halved by each level, so their number follows
    the logarithm of the lists. None if the levels would be longer than MOST_WORDS.
    """
    listed = stored(listed.select("key").filter("key is not null").distinct(), "keys")
    others = stored(universe.filter("key is not null").select("key").distinct().join(listed, "key", "left_anti"), "keys")
    levels: list[Level] = []
    inside, outside, n_outside = listed, others, others.count()
    while True:
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys have equal hashes")
        level = bloom(inside, n_outside, len(levels))
        if level is None or len(level.words) + sum(len(x.words) for x in levels) > MOST_WORDS:
            return None
        levels.append(level)
        wrong = stored(outside.filter(_passes(level, F.col("key"))), "keys") if n_outside else outside
        n_wrong = wrong.count() if n_outside else 0
        if not n_wrong:
            return levels
        # what the level let through is encoded next, against the keys the level encodes
        inside, outside, n_outside = wrong, inside, inside.count()


def _passes(level: Level, key: Column) -> Column:
    sent = SparkSession.active().sparkContext.broadcast(level)

    @F.arrow_udf("boolean")
    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(sent.value.passes(_array(a), _array(b)))

    return test(*hashes_of(key))


def members(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: the first level that rejects one decides by its depth."""
    out, left = np.full(len(a), len(levels) % 2 == 1), np.arange(len(a))
    for level in levels:
        ok = level.passes(a[left], b[left])
        out[left[~ok]] = level.depth % 2 == 1
        left = left[ok]
    return out


def member(levels: list[Level], key: Column) -> Column:
    """``members`` for a column of keys; a null is no member."""
    sent = SparkSession.active().sparkContext.broadcast(levels)

    @F.arrow_udf("boolean")
    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(members(sent.value, _array(a), _array(b)))

    return F.when(key.isNull(), F.lit(False)).otherwise(test(*hashes_of(key)))


def _best(key: Column, verdict: Column) -> Column:
    """What is compared between the rules that fit a url: the greatest wins."""
    name = F.translate(key, "\n", "")
    return F.struct(F.length(name).alias("n"), F.instr(key, "\n").alias("h"), verdict.alias("verdict"), name.alias("rule"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``rules`` are Rules or a table of verdict, host, path. A rule fits its host and all subdomains where the
    path starts with its own; the longest name (host + path) wins, of equally long ones that with the longer
    host, and block wins where one name is listed twice. Where none fits, rule is null and the verdict is
    ``default``. Null and odd urls have an empty host and path, which no rule fits. Repeated rows are judged
    alike; other columns are not read; an empty table gives no rows. There is one cascade for each verdict's
    keys; where they would be longer than MOST_WORDS the keys are joined instead.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    listed = rules.select("verdict", F.concat("host", F.lit("\n"), "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    listed = stored(listed.distinct(), "rules")
    shapes = sorted(map(tuple, listed.select("labels", "length").distinct().collect()))  # pairs of two small numbers
    verdicts = sorted(r.verdict for r in listed.select("verdict").distinct().collect())
    pages = with_host_and_path(pages.select("page_id", F.col("url").cast("string").alias("url"))).select("page_id", "host", "path")
    keys = keys_of(F.col("host"), F.col("path"), shapes)
    universe = stored(pages.select("host", "path").distinct().select(F.explode(keys).alias("key")).filter("key is not null").distinct(), "keys")
    cascades = [cascade(listed.filter(F.col("verdict") == v).select("key"), universe) for v in verdicts]
    if any(c is None for c in cascades):
        return _joined(pages, listed, keys, default)
    sent = spark.sparkContext.broadcast(cascades)

    @F.arrow_udf("array<int>")
    def hits(a: pa.Array, b: pa.Array) -> pa.Array:
        """The numbers of the keys that are listed, times the verdicts, plus the verdict's number."""
        one, two, known = a.flatten(), b.flatten(), np.asarray(a.flatten().is_valid())
        ends = np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) if len(a) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(a)), np.diff(ends, prepend=0))
        place = np.arange(len(row)) - np.concatenate(([0], ends))[row]
        found = np.stack([members(levels, _array(one), _array(two)) & known for levels in sent.value], axis=1) if len(row) else np.zeros((0, 1), bool)
        at, v = np.nonzero(found)
        upto = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=len(a))))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(upto), pa.array((place[at] * found.shape[1] + v).astype(np.int32)))

    each = lambda i: F.transform("keys", lambda k: F.when(k.isNotNull(), hashes_of(k)[i]))
    names = F.array(*[F.lit(v) for v in verdicts])
    out = pages.withColumn("keys", keys).withColumn("found", hits(each(0), each(1)))
    best = F.array_max(F.transform("found", lambda f: _best(F.get("keys", F.floor(f / len(verdicts)).cast("int")), F.get(names, f % len(verdicts)))))
    return _told(out.withColumn("best", best), default)


def _told(rows: DataFrame, default: str) -> DataFrame:
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def _joined(pages: DataFrame, listed: DataFrame, keys: Column, default: str) -> DataFrame:
    """``judged`` for lists too long for a cascade: the distinct hosts and paths are joined with the list."""
    own = pages.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key")).join(listed.select("key", "verdict"), "key")
    best = own.groupBy(F.col("host").alias("of_host"), F.col("path").alias("of_path")).agg(F.max(_best(F.col("key"), F.col("verdict"))).alias("best"))
    return _told(pages.join(best, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left"), default)
