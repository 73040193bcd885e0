"""URL filter: a blocked Bloom filter of listed keys, then an exact hash join.

A rule is a host and a path.  It fits a url if the url's host is the rule's
host or a subdomain of it and the url's path starts with the rule's path; the
longest fitting rule decides.  Each url gives the keys a rule could have (every
host suffix with every path prefix of a listed length); a key that the Bloom
filter may hold goes to the exact join, which removes false positives.

Defined results: a null url, or one without ``://``, has an empty host and
path; such a url is judged like any other (only a rule with an empty host could
fit).  A rule listed twice counts once, ``block`` before ``allow``.  Null rules
are ignored.  An empty list allows everything.  Repeated rows stay repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import broadcast_if_small
from .shared import ascii_lower, col, free_name

#: Fixed values of the filter: four words of 64 bits make a block, two bits are set in each word.
WORDS, BITS_PER_KEY = 4, 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """The two bits of ``key`` in one word of its block."""
    second = F.xxhash64(key, F.lit(word))
    one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, shift).bitwiseAND(63).cast("int"))
    return one(0).bitwiseOR(one(8))


def bloom_filter(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """Rows (block, w0..w3) of the blocked filter over ``keys``, and the number of blocks."""
    blocks = max(1, math.ceil(n * BITS_PER_KEY / (64 * WORDS)))
    table = keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(
        *[F.bit_or(_mask(F.col(key), w)).alias(f"w{w}") for w in range(WORDS)]
    )
    return table, blocks


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules`` has host, path and verdict (``block`` or ``allow``).  The list may
    be of any size: the filter and the list are broadcast only if measured small.
    Names that ``pages`` has already are replaced.
    """
    listed = (
        rules.filter("host IS NOT NULL AND path IS NOT NULL")
        .select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), "verdict")
        .groupBy("h", "p")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(F.concat("h", "p").alias("key"), "h", "p", "rule_verdict")
    )
    facts = listed.agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.length("p"))).alias("cuts"),
        F.array_sort(F.collect_set(F.size(F.split("h", r"\.")))).alias("depths"),
    ).first()
    base = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")])
    host, path = split_url(col(url_col))
    base = base.withColumns({"host": host, "path": path})
    if not facts["n"]:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})

    # Only (suffix, prefix) pairs whose shape some rule has are tried.
    labels = F.split("host", r"\.")
    suffixes = F.filter(
        F.array(*[F.when(F.size(labels) >= d, F.substring_index("host", ".", -d)) for d in facts["depths"]]), lambda x: x.isNotNull()
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= c, F.substring("path", 1, c)) for c in facts["cuts"]]), lambda x: x.isNotNull()
    )
    probes = (
        base.select("host", "path").distinct()
        .select("host", "path", F.explode_outer(suffixes).alias("h"), prefixes.alias("ps"))
        .filter(F.col("h").isNotNull())
        .select("host", "path", "h", F.explode_outer("ps").alias("p"))
        .filter(F.col("p").isNotNull())
        .withColumn("key", F.concat("h", "p"))
    )
    bloom, blocks = bloom_filter(listed, "key", facts["n"])
    possible = probes.withColumn("block", _block(F.col("key"), blocks)).join(broadcast_if_small(bloom), "block")
    for w in range(WORDS):
        possible = possible.filter(F.col(f"w{w}").bitwiseAND(_mask(F.col("key"), w)) == _mask(F.col("key"), w))
    fits = (
        possible.select("host", "path", "key", "h", "p")
        .join(broadcast_if_small(listed), ["key", "h", "p"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("key").alias("n"), F.length("h").alias("m"), "key", "rule_verdict")).alias("best"))
        .select("host", "path", F.col("best.key").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    )
    order = [c for c in base.columns if c not in ("host", "path")]
    joined = base.join(fits, ["host", "path"], "left")
    return joined.select(*[col(c) for c in order], "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
