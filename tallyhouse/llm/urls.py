"""URL filters: ordered host/path rules, then a blocked Bloom filter with an exact join.

A list can be given, or made of what pages say: ``thin_urls`` lists the canonical URLs
of pages whose article has few words, and ``filter_urls`` then finds every page at such
a URL, however it is spelled.  Listed canonical URLs go into a blocked Bloom filter: a key chooses one block of
eight 64-bit words and sets one bit in each.  Blocks are rows of a DataFrame, so
the filter is built by one aggregation and probed by one join on the block
number.  It is broadcast only while its size, known from the number of listed
URLs, is at most ``max_broadcast_bytes``; beyond that the same join shuffles.
Possible hits alone go to an exact hash join that removes false positives.

Defined results: a url that is null or lacks ``://`` has an empty host and path,
fits no rule and is never listed; repeated rows each get a row; an empty table
gives no rows; an empty list lists nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import lower_ascii, stored, words_of

WORDS = 8
#: What a listed URL takes in a broadcast, at a guess on the safe side.
KEY_BYTES = 512
#: Query parameters that only track a visit.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
#: Subdomains under which a site repeats its pages, and endings that name the same page.
SITE = r"^((www|m)\.)+"
ENDING = r"(\.html?|/)+$"
ARTICLE = r"(?s)<article>(.*?)</article>"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Scheme, ``www.`` and ``m.``, default port, fragment, tracking parameters, a last slash
    or ``.html`` and the order of parameters make no difference; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), SITE, "")
    path = F.regexp_replace(path, ENDING, "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.concat_ws("&", params))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def parsed(pages: DataFrame) -> DataFrame:
    return (
        pages.select("page_id", "url")
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .withColumn("canonical", canonical(F.col("url"), F.col("host"), F.col("path")))
    )


def thin_urls(pages: DataFrame, min_words: int) -> DataFrame:
    """canonical: of the pages whose html holds an article of fewer than ``min_words`` words (null html: none), stored."""
    body = F.regexp_extract("html", ARTICLE, 1)
    thin = pages.where((body != "") & (F.size(words_of(F.regexp_replace(body, TAG, " "))) < min_words))
    url = F.col("url")
    return stored(thin.select(canonical(url, host_of(url), path_of(url)).alias("canonical")).where("canonical is not null").distinct(), "url-list")


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls without one.

    ``rules``: (verdict, host, path), at most some hundred: they become one conditional
    expression.  Equally long rules: the longer host first, then block before allow.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    longest_last = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block", r[1:]))
    for what, rule_host, rule_path in longest_last:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit in each word, six bits of a second hash for each."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """block and its words w0..w7; ``keys`` has the column canonical."""
    masks = _masks(F.col("canonical"))
    return keys.select(_block(F.col("canonical"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    bits_per_key: int = 24,
    max_broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """page_id, host, path, rule, verdict, listed.

    ``listed`` has a column canonical (made by ``canonical``), and is stored or cheap to read.  Verdict: the rule's,
    else block for a listed url, else allow.
    """
    keys = listed.select("canonical").where("canonical is not null").distinct()
    n_keys = keys.count()
    blocks = max(1, -(-n_keys * bits_per_key // (64 * WORDS)))
    bloom = bloom_filter(keys, blocks)
    if blocks * 8 * (WORDS + 2) <= max_broadcast_bytes:
        bloom = F.broadcast(bloom)
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    key = F.coalesce("canonical", F.col("page_id").cast("string"))  # urls without a host are spread over all blocks
    probed = parsed(pages).withColumn("rule", rule).withColumn("verdict", verdict).withColumn("block", _block(key, blocks)).join(bloom, "block", "left")
    held = [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col("canonical")))]
    possible = F.col("canonical").isNotNull() & F.col("w0").isNotNull()
    for x in held:
        possible = possible & x
    possible = F.coalesce(possible, F.lit(False))
    told = probed.withColumn("wanted", F.when(possible, F.col("canonical"))).select("page_id", "host", "path", "rule", "verdict", "wanted")
    exact = keys.select(F.col("canonical").alias("wanted"), F.lit(True).alias("listed"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    found = F.coalesce("listed", F.lit(False)).alias("listed")
    if n_keys * KEY_BYTES <= max_broadcast_bytes:
        judged = told.join(F.broadcast(exact), "wanted", "left").select(*columns, found)
    else:  # only possible hits are shuffled
        hits = told.where("wanted is not null").join(exact.hint("shuffle_hash"), "wanted", "left").select(*columns, found)
        judged = told.where("wanted is null").select(*columns, F.lit(False).alias("listed")).unionByName(hits)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
