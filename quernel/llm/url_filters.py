"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A rule is a host and a path; its canonical URL is the two strung together. It fits a URL when the URL's host is the
rule's or a subdomain of it and the URL's path starts with the rule's path; the longest fitting rule wins. Every URL is
therefore looked up under its host suffixes of the numbers of labels that occur in the list, combined with its path prefixes of the lengths
that occur there.

The Bloom filter is split into 64-bit blocks: one hash picks the block, four more set bits in it, so a probe reads one
word. Its size is ``2 ** ceil(log2(rules / 4))`` words and at most ``max_words`` (8 bytes each), so what is broadcast has a
fixed bound. It has no false negatives; false positives are removed by the exact join with the list.

Probes work on distinct URLs, so a hot URL costs nothing more; the way back to the rows is an ordinary left join, in which rows without a URL
are spread.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; URLs that no rule fits are
allowed (this method blocks only what is listed); repeated rows are judged alike; very long URLs, also of many labels, are looked up like any
other, in time that grows with their length; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.exact_dedup import LOWER, UPPER

RULES = [  # fixed values: verdict, host, path
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MAX_WORDS = 1 << 20


def url_host(url: Column) -> Column:
    return F.when(_valid(url), F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    return F.when(_valid(url), F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _valid(url: Column) -> Column:
    return F.coalesce(F.instr(url, "://") > 0, F.lit(False))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_table(spark, rules=RULES) -> DataFrame:
    """The list as a table (rule, verdict, host, path); a large list is read from storage with these columns instead."""
    values = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in rules)
    return spark.sql(f"SELECT concat(host, path) AS rule, verdict, host, path FROM VALUES {values} AS t(verdict, host, path)")


def bloom_words(rule_count: int, max_words: int = MAX_WORDS) -> int:
    return min(max_words, 1 << max(0, math.ceil(math.log2(max(1, rule_count) / 4))))


def bloom_block(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), key), F.lit(words)).cast("int")


def bloom_mask(key: Column) -> Column:
    bits = F.xxhash64(F.lit(12), key)
    mask = F.lit(0).cast("long")
    for i in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def build_bloom(keys: DataFrame, words: int) -> DataFrame:
    """(block, word): at most ``words`` rows."""
    return keys.groupBy(bloom_block(F.col("key"), words).alias("block")).agg(F.bit_or(bloom_mask(F.col("key"))).alias("word"))


def judge_urls(urls: DataFrame, rules: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """rule and verdict for each distinct ``url`` that a rule fits: (url, rule, verdict)."""
    label_count = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    stats = rules.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths"), F.array_sort(F.collect_set(label_count)).alias("labels")).first()
    if not stats["n"]:
        return urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    words, lengths = bloom_words(stats["n"], max_words), stats["lengths"]
    parts = urls.filter(F.col("url").isNotNull()).select("url").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    suffixes = F.filter(F.array(*[F.when(label_count >= n, F.substring_index("host", ".", -n)) for n in stats["labels"]]), lambda s: s.isNotNull())
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    probes = (
        parts.filter(_valid(F.col("url")))
        .select("url", "path", F.explode(suffixes).alias("suffix"))
        .select("url", "suffix", F.explode(prefixes).alias("prefix"))
        .withColumn("key", F.concat("suffix", "prefix"))
    )
    bloom = build_bloom(rules.select(F.col("rule").alias("key")), words)
    mask = bloom_mask(F.col("key"))
    possible = (
        probes.withColumn("block", bloom_block(F.col("key"), words))
        .join(F.broadcast(bloom), "block")
        .filter(F.col("word").bitwiseAND(mask) == mask)
        .select("url", "suffix", "prefix")
    )
    exact = possible.join(
        rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "rule", "verdict"), ["suffix", "prefix"]
    )
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("suffix"), "rule"))
    return exact.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict."""
    judged = judge_urls(pages.select("url"), rules, max_words).withColumn("spread", F.lit(0).cast("long"))
    rows = pages.select("page_id", "url").withColumn("spread", F.when(F.col("url").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long")))
    return rows.join(judged, ["url", "spread"], "left").select(
        "page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
WITH rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
parts AS (
  SELECT page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '\A([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '\A[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
judged AS (SELECT p.*, (SELECT max_by({{'rule': h || r.p, 'verdict': verdict}}, length(h || r.p)) FROM rules r
   WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, r.p)) AS best FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""
