"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

The list may be large, so it is not broadcast. A Bloom filter of it is: blocks of 512 bits, all bits of a URL in one
block, at most ``blocks`` of them (64 bytes each), whatever the length of the list. It is built by or-ing bits in one
aggregation and looked up by a hash join on the block number, all in SQL functions. URLs that pass, the listed ones and
few others (more, the fuller the filter), go to an exact join with the list, which removes the false ones. A full filter
costs speed, never a wrong verdict.

A canonical URL is host and path: without scheme, query, fragment, ``www.`` in front and slashes or ``.html`` at the end.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and is not listed; an empty list
or table gives no hit; repeated rows are each judged; ties between rules cannot happen, the longest (host, then path)
being one; other columns are kept by ``judge``, those named like its results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm.common import query, table

BLOCKS = 1 << 14  # of 512 bits: 1 MB of bits at most
WORDS, PROBES = 8, 6  # longs in a block, bits of a URL


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html|/)+$", ""))


def fits(host: Column, path: Column, rule: str) -> Column:
    """Whether ``host/path`` of a rule fits: the host or a subdomain of it, and a path that starts like the rule's."""
    rule_host, _, rule_path = rule.partition("/")
    own = (host == rule_host) | host.endswith(f".{rule_host}")
    return own & path.startswith(f"/{rule_path}")


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The rule that fits with the longest host, then the longest path; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.partition("/")[0]), -len(r)))
    return F.coalesce(*(F.when(fits(host, path, r), F.lit(r)) for r in ordered))


def _bits(h: Column) -> tuple[Column, list[tuple[Column, Column]]]:
    """Block of a hash, and for each probe the word in the block and the bit in the word."""
    block = F.pmod(h, F.lit(BLOCKS)).cast("int")
    probes = []
    for k in range(PROBES):
        nine = F.shiftright(h, 14 + 8 * k).bitwiseAND(511).cast("int")
        probes.append((F.shiftright(nine, 6), nine.bitwiseAND(63)))
    return block, probes


def bloom(listed: DataFrame, key: str) -> DataFrame:
    """``block, w0 .. w7`` of the hashes of a column; at most BLOCKS rows."""
    block, probes = _bits(F.xxhash64(key))
    one = F.lit(1).cast("bigint")
    words = []
    for w in range(WORDS):
        mask = F.lit(0).cast("bigint")
        for word, bit in probes:
            mask = mask.bitwiseOR(F.when(word == w, F.call_function("shiftleft", one, bit)).otherwise(F.lit(0).cast("bigint")))
        words.append(F.bit_or(mask).alias(f"w{w}"))
    return listed.groupBy(block.alias("block")).agg(*words)


def possible(rows: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """Rows whose key may be listed. The filter has a fixed largest size, so it is broadcast."""
    block, probes = _bits(F.xxhash64(key))
    joined = rows.withColumn("_block", block).join(F.broadcast(filter_), F.col("_block") == F.col("block"))
    for word, bit in probes:
        chosen = F.coalesce(*(F.when(word == w, F.col(f"w{w}")) for w in range(WORDS)))
        joined = joined.where(F.call_function("shiftright", chosen, bit).bitwiseAND(1) == 1)
    return joined.select(rows.columns)


def listed_keys(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The distinct keys of ``rows`` that are in ``listed`` (one column, same name): filter, then the exact join."""
    listed = listed.select(key).where(F.col(key).isNotNull())
    hits = possible(rows.select(key).where(F.col(key).isNotNull()), key, bloom(listed, key))
    return hits.distinct().join(listed.distinct(), key, "left_semi")


def judge(pages: DataFrame, rules: dict[str, str], listed: DataFrame) -> DataFrame:
    """``pages``, all columns, with ``host, path, canonical_url, rule, verdict``: the rule's, else block if listed.

    ``listed`` has a column ``canonical_url``.
    """
    out = pages.withColumns({"host": host_of("url"), "path": path_of("url")})
    out = out.withColumns({"canonical_url": F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))), "rule": longest_rule(F.col("host"), F.col("path"), rules)})
    hits = listed_keys(out.where("rule IS NULL"), "canonical_url", listed).withColumn("_listed", F.lit(True))
    verdict = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()), F.when(F.col("_listed"), "block"), F.lit("allow"))
    return out.join(hits, "canonical_url", "left").withColumn("verdict", verdict).drop("_listed").select(*out.columns, "verdict")


#: Fixed rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Site names whose pages make the query's list of bad URLs.
BAD_SITES = ("cheap-pills", "spam-farm", "free-casino")


def bad_urls(pages: DataFrame) -> DataFrame:
    """The query's list, derived from the table: canonical URLs of pages on bad sites."""
    host, path = host_of("url"), path_of("url")
    bad = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, BAD_SITES)))
    return pages.where(bad).select(canonical(host, path).alias("canonical_url")).distinct()


HOST_SQL = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH_SQL = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
SQL = rf"""
WITH p AS (SELECT page_id, {HOST_SQL} AS host, {PATH_SQL} AS path FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/)+$', '') END AS canonical_url,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p),
bad AS (SELECT DISTINCT canonical_url FROM c WHERE list_has_any(string_split(host, '.'), ['cheap-pills', 'spam-farm', 'free-casino']))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN canonical_url IN (SELECT canonical_url FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM c
"""


@query("op5_urls", SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages, RULES, bad_urls(pages)).select("page_id", "host", "path", "rule", "verdict")
