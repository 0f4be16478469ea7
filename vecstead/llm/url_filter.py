"""URL rules by a Bloom filter cascade, in DataFrame functions alone.

A cascade holds a list of keys exactly with respect to a universe of keys. Its first level is a Bloom filter of the listed
keys; the second holds the universe's keys that pass the first by mistake; the third the listed keys that pass the second
by mistake; and so on until a level lets nothing through by mistake. Here the universe is every key that any url of the
corpus can ask for, so the answers are exact, and a url is judged by bit tests against literals, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import durable, quoted, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The verdict on a url that no rule fits.
UNLISTED = "allow"
#: Rules come from the caller, so a cascade has a bound: about 1.44 * log2(universe / rules) bits a rule. Checked.
MAX_BITS = 1 << 26


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty where the url is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that could be a rule fitting (host, path): each suffix of whole labels with each path start of a rule's length."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]

    def passes(self, key: Column, seed: int) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = []
        for i in range(self.hashes):
            at = position(key, seed, i, self.bits)
            tests.append(F.getbit(F.get(words, (at / 64).cast("int")), (at % 64).cast("int")) == 1)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def position(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits))


def bloom(keys: DataFrame, count: int, bits_a_key: float, seed: int) -> Level:
    """A Bloom filter of `keys.key`; the words come from an aggregation, so only the filter reaches the driver."""
    bits = max(64, math.ceil(count * bits_a_key / 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"a filter of {bits} bits is over the bound of {MAX_BITS}; give fewer rules at a time")
    hashes = max(1, min(20, round(bits_a_key * math.log(2))))
    at = F.explode(F.array(*[position(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("at")
    found = keys.select(at).select((F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("mask"))
    words = [0] * (bits // 64)
    for word, mask in found.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
        words[word] = mask
    return Level(bits, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]
    seed: int

    def holds(self, key: Column) -> Column:
        """True if the key is listed; exact for keys of the universe. The first level that rejects a key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].passes(key, self.seed + i), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, universe_size: int, seed: int) -> Cascade:
    """A cascade of `listed.key` over `universe.key`, both distinct. An empty list gives a cascade that holds nothing."""
    inside, levels = listed, []
    n = inside.count()
    if not n:
        return Cascade((), seed)
    outside = universe.join(listed, "key", "left_anti")
    bits_a_key = 1.44 * math.log2(max(2.0, universe_size / n)) + 4
    while n:
        level = bloom(inside, n, bits_a_key, seed + len(levels))
        levels.append(level)
        wrong = durable(outside.where(level.passes(F.col("key"), seed + len(levels) - 1)))
        inside, outside, n, bits_a_key = wrong, inside, wrong.count(), 3.0
    return Cascade(tuple(levels), seed)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", unlisted: str = UNLISTED) -> DataFrame:
    """`pages` with host, path, rule and verdict of each url.

    A rule fits its host and all subdomains where the path starts with the rule's path; of those that fit, the longest host
    and path together win. Null urls, urls without `://` and urls that no rule fits have a null rule and the verdict
    `unlisted`. Rules of one host and path are one rule, and two verdicts for it raise, so there are no ties; urls of any
    length are read whole. Repeated rows each get their row; an empty table gives an empty one; columns of `pages` that are called
    host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    keys: dict[str, str] = {}
    for r in rules:
        if keys.setdefault(r.key, r.verdict) != r.verdict:
            raise ValueError(f"{r.key} has two verdicts")
    lengths = sorted({len(r.path) for r in rules})
    split = pages.withColumn("__url", F.col(quoted(url)))
    host, path = split_url(F.col("__url"))
    split = split.withColumns({"host": host, "path": path}).drop("__url")
    asked = candidates(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")

    universe = split.select("host", "path").distinct().select(F.explode(asked).alias("key")).distinct()
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    verdicts = sorted(set(keys.values()))
    cascades = {v: build_cascade(spark.createDataFrame([(k,) for k, x in keys.items() if x == v], "key string"), universe, size, 1000 * (i + 1)) for i, v in enumerate(verdicts)}

    def verdict_on(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for v in verdicts:
            out = F.when(cascades[v].holds(key), F.lit(v)).otherwise(out)
        return out

    judged = F.transform(asked, lambda key: F.struct(F.length(key).alias("n"), key.alias("rule"), verdict_on(key).alias("verdict")))
    best = F.array_max(F.filter(judged, lambda x: x["verdict"].isNotNull()))
    return (
        split.withColumn("__best", best)
        .withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(unlisted))})
        .drop("__best")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
ORACLE = f"""
with rules(rh, rp, v) as (values {_RULE_ROWS}),
rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) as path from rest),
fits as (
  select p.*, case when (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp) then rh || rp end as rule,
         v from parts p cross join rules)
select page_id, host, path, max_by(rule, length(rule)) as rule,
       coalesce(max_by(v, length(rule)) filter (rule is not null), '{UNLISTED}') as verdict
from fits group by page_id, host, path
"""
