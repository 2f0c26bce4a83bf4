"""URL filter: host and path rules, then a list of canonical URLs.

A rule names a host and a path; it fits that host and its subdomains where the
path of the URL starts with the rule's, and the longest rule that fits decides.
URLs without a rule are looked up in the list: a blocked Bloom filter (blocks of
256 bits, BITS bits set in the one block of a URL) passes possible hits to an
exact hash join that removes the false positives; the rest never moves.

The filter is a table of blocks.  Its size follows the list and is known from a
count: up to BROADCAST_BYTES it is broadcast, beyond that it is joined by block with
the distinct URLs.  Possible hits are counted by URL before they meet the list, so a
URL travels once however many pages have it, and the URLs found go back to the pages:
broadcast where they are FOUND_ROWS at most, else joined with hot ones apart.
Only DataFrame functions are used.

Null, empty and very long URLs are taken like others; such without "://" have an empty
host and path, fit no rule and are not in the list.  Repeated rows each give a row and
repeated list entries count once; of rules of equal length the first by name wins.
Either table may be empty.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS, BLOCK_BITS, BITS_PER_URL = 8, 256, 16
BROADCAST_BYTES, FOUND_ROWS = 64 << 20, 500_000
#: Query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: The list of op4 is made by rule: these sites in each top domain, language and number.
SITES, DOMAINS, LANGUAGES = ("casino-win", "free-bets", "cheap-pills"), ("example.com", "example.net", "example.org"), ("en", "de", "fr", "es")
FIRST, LAST = 1000, 5999


def listed_urls(spark: SparkSession) -> DataFrame:
    """url: the list of op4, which no other table has a part in."""
    rows = spark.range(FIRST, LAST + 1)
    for name, values in (("site", SITES), ("domain", DOMAINS), ("lang", LANGUAGES)):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows.select(F.concat(F.lit("https://"), "site", F.lit("."), "domain", F.lit("/"), "lang", F.lit("/"), F.col("id").cast("string")).alias("url"))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www., m. and default ports, path without .html and closing
    slashes, parameters sorted and without tracking ones; empty without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html?|/)+$", "")
    query = F.split(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host_of(url) == "", F.lit("")).otherwise(F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _words(url: Column) -> list[Column]:
    """The four 64-bit words of a URL's bits in its block."""
    h = F.xxhash64(url, F.lit("bits"))
    words = [F.lit(0).cast("long")] * 4
    for i in range(BITS):
        at = F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        words = [w.bitwiseOR(F.when(F.shiftrightunsigned(at, 6) == k, bit).otherwise(F.lit(0).cast("long"))) for k, w in enumerate(words)]
    return words


def block_of(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocks that have bits: block, w0 to w3.  listed: one column `canon`."""
    rows = listed.select(block_of(F.col("canon"), blocks).alias("block"), *[w.alias(f"b{k}") for k, w in enumerate(_words(F.col("canon")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(4)])


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", listed_verdict: str = "block", other_verdict: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict.  listed: one column of URLs."""
    listed = common.stored(listed.select(canonical(F.col(f"`{listed.columns[0]}`")).alias("canon")).where("canon <> ''").distinct(), "listed-urls")
    blocks = max(1, listed.count() * BITS_PER_URL // BLOCK_BITS)
    table = common.stored(bloom(listed, blocks), "bloom-blocks")

    url = F.col("url")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    possible = F.lit(True)
    for k, bits in enumerate(_words(F.col("canon"))):
        possible = possible & (F.col(f"w{k}").bitwiseAND(bits) == bits)
    asked = rows.where("r is null and canon <> ''").select("canon").withColumn("block", block_of(F.col("canon"), blocks))
    if blocks * 40 <= BROADCAST_BYTES:
        hits = asked.join(F.broadcast(table), "block").where(possible).groupBy("canon").agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = asked.groupBy("canon", "block").agg(F.count(F.lit(1)).alias("n"))
        hits = counted.join(table, "block").where(possible).select("canon", "n")
    found = common.stored(hits.join(listed, "canon").withColumn("is_listed", F.lit(True)), "urls-found")

    probe = F.when(F.col("r").isNull(), F.col("canon"))
    rows = rows.select("page_id", "host", "path", "r", probe.alias("canon"))
    if found.count() <= FOUND_ROWS:
        joined = rows.join(F.broadcast(found), "canon", "left")
    else:
        most = common.hot_bound(pages.count())
        hot, cold = F.broadcast(found.where(F.col("n") > most)), found.where(F.col("n") <= most)
        rest = rows.where("canon is not null").join(hot.select("canon"), "canon", "left_anti").join(cold, "canon", "left")
        ruled = rows.where("canon is null").select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("is_listed"))
        joined = rows.join(hot, "canon").unionByName(rest).unionByName(ruled)
    verdict = F.when(F.col("r").isNotNull(), F.col("r.verdict")).when(F.col("is_listed"), F.lit(listed_verdict)).otherwise(F.lit(other_verdict))
    return joined.select("page_id", "host", "path", "r.rule", verdict.alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), listed_urls(spark))


OP4_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM a),
c AS (SELECT page_id, host, path, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS kept FROM b),
d AS (SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE
      regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(path, '(\.html?|/)+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canon FROM c),
l AS (SELECT s.site || '.' || m.dom || '/' || g.lang || '/' || CAST(n.i AS VARCHAR) AS canon
      FROM (SELECT unnest(['casino-win', 'free-bets', 'cheap-pills']) AS site) s, (SELECT unnest(['example.com', 'example.net', 'example.org']) AS dom) m,
           (SELECT unnest(['en', 'de', 'fr', 'es']) AS lang) g, (SELECT unnest(range(1000, 6000)) AS i) n),
r AS (SELECT d.*, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN l ON r.canon = l.canon
"""
