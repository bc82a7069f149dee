"""Exact key membership by a cascade of Bloom filters, and host and path rules for urls.

Level 0 holds the listed keys. Some other keys of the corpus pass it by chance; they are known,
because the cascade is built over the complete set of the corpus's keys, and level 1 holds them.
Listed keys that pass level 1 by chance go to level 2, and so on until nothing passes by chance. A
key is listed when the first level that it fails is odd. The answer is exact for every key of the
universe, and a probe is a few bit tests on words that each task holds: no join.

A level's size follows from its keys: ``BITS`` bits a key. The keys are dealt over segments by a
hash, as many as keep every level of a segment at about ``SEGMENT_KEYS`` keys, whether the list is long or the
corpus has so many other keys that level 1 would be large (1.3 MB a level). A scan probes up to ``SEGMENTS``
segments, a row only that of its key; more take further scans, each over the rows of its own segments.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saddle.storage import materialise

BITS = 10
HASHES = 5
SEGMENT_KEYS, SEGMENTS = 1 << 20, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path); the longest rule that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _position(key: Column, level: int, turn: int, bits: int) -> Column:
    """Bit of ``key`` for one of the level's hash functions (double hashing)."""
    first, second = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    size = F.lit(bits).cast("bigint")
    return F.pmod(F.pmod(first, size) + F.lit(turn) * (F.pmod(second, size - 1) + 1), size)


def _filter(keys: DataFrame, level: int, words: int) -> DataFrame:
    """One row: the level's bits as an array of 64-bit words, written."""
    spark = keys.sparkSession
    turns = F.explode(F.array(*[_position(F.col("key"), level, t, words * 64) for t in range(HASHES)]))
    ones = keys.select(turns.alias("bit")).select(
        F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("mask"))
    dense = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    filled = ones.unionByName(dense).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    packed = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return materialise(filled.agg(F.transform(packed, lambda x: x["mask"]).alias("words")))


class Cascade:
    """The filters of one segment. ``member(key)`` is true exactly for listed keys of the universe."""

    def __init__(self, levels: list[tuple[int, DataFrame]]):
        self.levels = levels

    def _passes(self, level: int, key: Column) -> Column:
        words, stored = self.levels[level]
        bits = stored.scalar()
        tests = []
        for turn in range(HASHES):
            at = _position(key, level, turn, words * 64)
            tests.append(F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return reduce(lambda a, b: a & b, tests)

    def member(self, key: Column) -> Column:
        """Failing an even level means not listed, failing an odd one means listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self._passes(level, key), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def build_cascade(universe: DataFrame) -> Cascade:
    """From ``universe(key, listed)``, one row per key. Each level's keys are those that the one before let pass wrongly."""
    inside, outside = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
    levels: list[tuple[int, DataFrame]] = []
    count = inside.count()
    while count:
        level, words = len(levels), max(1, -(-count * BITS // 64))
        levels.append((words, _filter(inside, level, words)))
        passes = Cascade(levels)._passes(level, F.col("key"))
        inside, outside = materialise(outside.where(passes)), inside
        count = inside.count()
    return Cascade(levels)


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(segments).cast("bigint"))


def mark_listed(rows: DataFrame, key: str, listed: DataFrame, name: str = "listed") -> DataFrame:
    """Adds ``name``: whether the column ``key`` is in ``listed(key)``; null keys are not.

    The universe is every key of ``rows`` and of ``listed``.
    """
    seen = rows.select(F.col(key).alias("key"), F.lit(False).alias("listed"))
    wanted = listed.select("key", F.lit(True).alias("listed"))
    universe = materialise(seen.unionByName(wanted).where(F.col("key").isNotNull())
                           .groupBy("key").agg(F.max("listed").alias("listed")))
    counts = universe.agg(F.count_if("listed").alias("inside"), F.count_if(~F.col("listed")).alias("outside")).first()
    # a level holds the listed keys or what the level before lets pass wrongly, so the larger of the first two bounds them all
    largest = max(counts["inside"], math.ceil(counts["outside"] * (1 - math.exp(-HASHES / BITS)) ** HASHES))
    segments = max(1, -(-largest // SEGMENT_KEYS))
    parts = []
    for first in range(0, segments, SEGMENTS):
        own = range(first, min(first + SEGMENTS, segments))
        answer = F.lit(False)
        for s in own:
            cascade = build_cascade(universe.where(_segment(F.col("key"), segments) == s) if segments > 1 else universe)
            answer = F.when(_segment(F.col(key), segments) == s, cascade.member(F.col(key))).otherwise(answer) if segments > 1 else cascade.member(F.col(key))
        mine = rows if segments <= SEGMENTS else rows.where(F.coalesce(_segment(F.col(key), segments), F.lit(0)).between(own[0], own[-1]))
        parts.append(mine.withColumn(name, F.col(key).isNotNull() & answer))
    return reduce(DataFrame.unionByName, parts)


# -- urls ----------------------------------------------------------------------------------

def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def hosts_under(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """The distinct ``key`` of ``hosts(key)`` that equal or lie under one of ``domains(key)``."""
    labels = F.split("key", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.distinct().select("key", F.explode(parents).alias("domain"))
    return each.join(domains.select(F.col("key").alias("domain")).distinct(), "domain", "left_semi").select("key").distinct()


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host and path fit, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def judge_urls(pages: DataFrame, domains: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row.

    A rule decides where one fits; otherwise a page is blocked exactly when its host equals or lies
    under a domain of ``domains(key)``. The domains are resolved once over the distinct hosts; the
    rows themselves meet only the cascade. Null urls and urls without ``://`` have an empty host and
    path, fit no rule and are allowed. Repeated rows are judged each; other columns are not read, so
    their names cannot clash; an empty table gives an empty result.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    hosts = parts.select(F.col("host").alias("key"))
    marked = mark_listed(parts, "host", hosts_under(hosts, domains))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return marked.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")
