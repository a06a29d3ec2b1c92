"""URL filters by a Bloom filter cascade.

Rules (host, path) judge the urls they fit, the longest first. Hosts with a page that a rule blocks are listed, and a
page that no rule fits is blocked if its host is listed. A first Bloom filter holds the listed hosts; of the corpus's
other hosts, some pass it by chance and go into a second one; of the listed hosts some pass that and go into a third; and so on
until none passes. As the levels were built over every host of the corpus, the first level that a host fails tells
exactly whether it is listed. Filters are arrays of 64-bit words from bitwise aggregates, read as scalar subqueries: no join and
no Python. Hosts are dealt to segments by hash, each with a cascade of its own, so that a filter's size has a bound and
only the number of segments grows with the list; with several, pages without a rule are written by segment, so that each
segment's filters are read for its own pages only.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule, and is judged as the
empty host (not listed: allow); letters other than A-Z keep their case; equal rows get equal verdicts; of rules that fit with equal
length the one that is greater as text wins; a very long url is read whole; a list or table that is empty lets everything pass;
null page_ids are rows like others; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BITS, PROBES, MOST_LEVELS = 10, 5, 60
#: Listed keys of a segment, and how many times as many others it may have: a hundredth of those come into the second level.
SEGMENT_KEYS, OTHERS = 1 << 20, 64


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: tuple, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        its_host, slash, its_path = text.partition("/")
        fits = ((F.col(host) == its_host) | F.col(host).endswith("." + its_host)) & F.col(path).startswith(slash + its_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _places(key: str, level: int, bits: int) -> list[Column]:
    """Bits of a key, by double hashing on 31-bit halves (ANSI mode forbids overflow)."""
    h = F.xxhash64(F.col(key), F.lit(level))
    a, b = F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.pmod(a + b * F.lit(j), F.lit(bits)) for j in range(PROBES)]


class Cascade:
    """Exact membership of the keys of one corpus; ``levels``: (bits, one-row DataFrame with the words)."""

    def __init__(self, tables: Scratch, keys: DataFrame, name: str):
        """keys: ``key, listed``, each key once."""
        self.name = name
        self.levels: list[tuple[int, DataFrame]] = []
        sides = [keys.where("listed").select("key"), keys.where("NOT listed").select("key")]
        while n := sides[0].count():
            level = len(self.levels)
            if level >= MOST_LEVELS:
                raise ValueError("the cascade doesn't end: are keys listed and not listed at once?")
            self.levels.append(self._filter(tables, sides[0], n, level))
            passed = tables.store(sides[1].where(self._passes("key", level)), f"{name}_passed{level}")
            sides = [passed, sides[0]]

    def _filter(self, tables: Scratch, keys: DataFrame, n: int, level: int) -> tuple[int, DataFrame]:
        words = -(-n * BITS // 64)
        place = keys.select(F.explode(F.array(*_places("key", level, 64 * words))).alias("place"))
        bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
        some = place.groupBy(F.expr("cast(place div 64 as long)").alias("at")).agg(F.bit_or(bit).alias("word"))
        blank = keys.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
        dense = some.unionByName(blank).groupBy("at").agg(F.bit_or("word").alias("word"))
        # one row whose size has a bound
        array = dense.agg(F.expr("transform(array_sort(collect_list(struct(at, word))), x -> x.word)").alias("words"))
        return 64 * words, tables.store(array, f"{self.name}_level{level}")

    def _passes(self, key: str, level: int) -> Column:
        bits, words = self.levels[level]
        array = words.scalar()
        out = F.lit(True)
        for place in _places(key, level, bits):
            word = F.element_at(array, F.shiftright(place, 6).cast("int") + 1)
            out = out & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out

    def holds(self, key: str = "key") -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge(pages: DataFrame, rules: tuple = RULES, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages(page_id, url)``."""
    spark = pages.sparkSession
    tables = Scratch(spark, "urls")
    host, path = host_and_path()
    rule, verdict = longest_rule(rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": verdict})
    listed = F.coalesce(F.max(F.col("ruled") == "block"), F.lit(False))
    keys = tables.store(urls.groupBy(F.col("host").alias("key")).agg(listed.alias("listed")), "keys")
    n, others = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    segments = max(1, -(-max(n, -(-others // OTHERS)) // segment_keys))
    if segments == 1:
        return _judged(urls, Cascade(tables, keys, "all"))
    in_segment = lambda key: F.pmod(F.xxhash64(key, F.lit(77)), F.lit(segments))
    keys = tables.store(keys.withColumn("segment", in_segment("key")).repartition("segment"), "dealt_keys", "segment")
    # a hot host's pages are spread over several tasks
    rest = urls.where("ruled IS NULL").withColumn("segment", in_segment("host")).repartition("segment", F.pmod(F.xxhash64("page_id"), F.lit(64)))
    rest = tables.store(rest, "dealt_urls", "segment")
    out = urls.where("ruled IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"))
    for k in range(segments):
        cascade = Cascade(tables, keys.where(F.col("segment") == k).select("key", "listed"), f"segment{k}")
        out = out.unionByName(_judged(rest.where(F.col("segment") == k), cascade))
    return out


def _judged(urls: DataFrame, cascade: Cascade) -> DataFrame:
    verdict = F.coalesce("ruled", F.when(cascade.holds("host"), "block").otherwise("allow"))
    return urls.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


OP9_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM urls
), listed AS (
  SELECT DISTINCT host FROM ruled WHERE rule IN ('net/', 'example.com/de/')
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
