"""URL filters: path rules first, then a listed-URL check by a blocked Bloom filter and an exact join.

Only DataFrame functions. A canonical URL is host (``www.`` dropped), path without a trailing ``/``
and the query's parameters, sorted, without ``utm_*`` and ``ref``; scheme and fragment are dropped.

The filter has up to ``MAX_BLOCKS`` blocks of eight 64-bit words; a listed URL sets one bit in each
word of its block. It is one small row per block, so the broadcast is bounded (65,536 x 72 bytes, 5 MB)
whatever the list holds: a longer list only lets more pages through to the exact join.

Nulls: a null URL, or one without ``://``, has empty host and path, fits no rule and is never listed.
Null entries of the list are ignored, repeated ones count once. Repeated pages are judged each. An empty
list allows whatever no rule blocks. Other columns of either input do not matter; names may clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 32
WORDS = 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(__url, position('://' IN __url) + 3)"))


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds __host, __path and __canon."""
    df = df.withColumn("__url", F.col(url))
    df = df.withColumn("__rest", _rest(F.col("__url")))
    bare = F.regexp_extract("__rest", "^([^?#]*)", 1)
    query = F.regexp_extract("__rest", r"^[^?#]*\?([^#]*)", 1)
    df = (df.withColumn("__host", F.coalesce(lower_ascii(F.regexp_extract("__rest", "^([^/?#]*)", 1)), F.lit("")))
            .withColumn("__path", F.coalesce(F.regexp_extract(bare, "^[^/]*(?s:(/.*))$", 1), F.lit("")))
            .withColumn("__args", F.array_sort(F.filter(F.split(query, "&"), lambda a: (a != "") & ~a.startswith("utm_")
                                                        & ~a.startswith("ref=")))))
    host = F.regexp_replace("__host", r"^www\.", "")
    canon = F.concat(host, F.regexp_replace("__path", "/+$", ""),
                     F.when(F.size("__args") > 0, F.concat(F.lit("?"), F.array_join("__args", "&"))).otherwise(""))
    return df.withColumn("__canon", F.when(F.col("__rest").isNotNull(), canon)).drop("__url", "__rest", "__args")


def rule_verdict(rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits, else null. ``rules`` is a
    short written list; long lists belong in ``listed``."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    host, path = F.col("__host"), F.col("__path")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def _bits(canon: Column) -> list[Column]:
    h = F.xxhash64(canon, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63)).cast("int"))
            for w in range(WORDS)]


def _block(canon: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(canon, F.lit(1)), F.lit(n_blocks))


def bloom_blocks(listed: DataFrame, canon: str, n_blocks: int) -> DataFrame:
    """One row per used block: (block, w0..w7)."""
    return (listed.withColumn("block", _block(F.col(canon), n_blocks)).groupBy("block")
            .agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col(canon)))]))


def filter_urls(pages: DataFrame, url: str, listed: DataFrame, listed_url: str,
                rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` with host, path, canonical_url, rule and verdict (allow or block) added."""
    names = with_parts(listed.select(F.col(listed_url).alias("__u")), "__u").where("__canon is not null")
    names = names.select("__canon").distinct()
    n_listed = names.count()
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and n_blocks * KEYS_PER_BLOCK < n_listed:
        n_blocks *= 2
    blocks = bloom_blocks(names, "__canon", n_blocks)
    p = with_parts(pages, url).withColumn("__block", _block(F.col("__canon"), n_blocks))
    probe = F.coalesce(F.lit(True), F.lit(True))
    for i, b in enumerate(_bits(F.col("__canon"))):
        probe = probe & (F.col(f"__f.w{i}").bitwiseAND(b) != 0)
    p = p.alias("__p").join(F.broadcast(blocks).alias("__f"), F.col("__block") == F.col("__f.block"), "left")
    p = p.select("__p.*", F.coalesce(probe, F.lit(False)).alias("__possible"))
    hits = p.where("__possible").join(names.withColumn("__listed", F.lit(True)), "__canon", "left")
    rest = p.where("not __possible").withColumn("__listed", F.lit(False))
    out = hits.unionByName(rest).withColumn("__rule", rule_verdict(rules))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "canonical_url", "rule", "verdict")],
                      F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__canon").alias("canonical_url"),
                      F.col("__rule.rule").alias("rule"),
                      F.coalesce(F.col("__rule.verdict"), F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict"))
