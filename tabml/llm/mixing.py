"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame functions. Texts of a source stand in hash order and are cut into blocks of equally
many words (at most ``BLOCK_WORDS``, less for a small source). A source's quota is its target in blocks. A binary
tree over the output shards splits the quotas: at each node the blocks that go left are drawn from a
multivariate hypergeometric law (source by source, each draw conditional on the ones before), so all
shards have equal totals and every split of the blocks is as likely as under one global shuffle. A
shard then takes a range, disjoint from all others, of each source's permuted blocks (a second and a third
pass follow the first where the target exceeds the source), and orders its blocks by a hash.

Hot sources: positions are running sums inside (source, hash bucket) groups of about ``BUCKET_ROWS`` rows
plus offsets of whole buckets, so no task orders a source. The tree works on one row per (node, source).

Nulls: a null text has size 0 and is in no block; a null source is a source of its own, last in order; null
ids are kept. Repeated rows are each mixed. Empty tables give no rows. Sizes all 0 give targets 0. The result
has the columns named below only, so clashing extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabml.llm.store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 256
BLOCKS_AT_LEAST = 1024
BUCKET_ROWS = 4096
MAX_EPOCHS = 3
#: Multipliers of the block permutation; primes, the second for block counts the first divides.
PRIMES = (1000003, 999983)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(scratch: Scratch, df: DataFrame, by: str) -> DataFrame:
    """``df`` with __rank 0.. in the order of ``by`` (distinct values): range partitions, then their offsets."""
    parts = scratch.table(df.repartitionByRange(8, by).withColumn("__pid", F.spark_partition_id()))
    offset = parts.groupBy("__pid").agg(F.count("*").alias("n"))
    offset = offset.select("__pid", (F.sum("n").over(Window.orderBy("__pid")) - F.col("n")).alias("__off"))  # 8 rows
    return (parts.withColumn("__i", F.row_number().over(Window.partitionBy("__pid").orderBy(by)) - 1)
            .join(offset, "__pid").withColumn("__rank", F.col("__i") + F.col("__off")).drop("__pid", "__i", "__off"))


def source_targets(scratch: Scratch, sizes: DataFrame, weights: list[float]) -> DataFrame:
    """(key, source_size, n_docs, target): weights repeat over sources by code point, null last; targets are shared out by
    weight and stop at MAX_EPOCHS times the source, the excess going to the others until none is above."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = ranked(scratch, per, "key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    per = scratch.table(per.withColumn("w", w).drop("__rank"))
    level, capped = 0.0, -1
    cap = F.col("source_size") * MAX_EPOCHS
    while True:
        over = F.lit(level) * F.col("w") > cap
        total, held, free, n = per.agg(F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("w"))),
                                       F.count(F.when(over, 1))).first()
        if n == capped or not total or not free:
            break
        capped, level = n, (total - (held or 0)) / free
    share = F.lit(level) * F.col("w")
    return per.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(k: Column, total: Column, n: Column, u: Column) -> Column:
    """Number of marked balls among n drawn from total with k marked, by inverting the probabilities outwards from the
    mode (weights relative to it, by the ratio of neighbours) until 12 standard deviations, where they are below 1e-30."""
    d = lambda c: c.cast("double")
    lo, hi = F.greatest(F.lit(0).cast("long"), n + k - total), F.least(k, n)
    mode = F.least(hi, F.greatest(lo, F.floor(d(n + 1) * d(k + 1) / d(total + 2)).cast("long")))
    share = F.when(total > 0, d(k) / d(total)).otherwise(F.lit(0.0))
    var = d(n) * share * (1 - share) * d(total - n) / d(F.greatest(total - 1, F.lit(1).cast("long")))
    wide = F.ceil(F.sqrt(F.greatest(var, F.lit(0.0))) * 12).cast("long") + 10
    wide = F.greatest(F.least(wide, F.greatest(hi - mode, mode - lo)), F.lit(1).cast("long"))
    given = F.struct(d(k).alias("k"), d(n).alias("n"), d(total - k - n).alias("r"), d(lo).alias("lo"), d(hi).alias("hi"),
                     d(mode).alias("m"), mode.alias("mode"), u.alias("u"), F.sequence(F.lit(1).cast("long"), wide).alias("steps"))

    def draw(g):
        def grow(a, t):  # weights of mode + t and mode - t, from those one nearer
            x, y = g["m"] + d(t), g["m"] - d(t)
            up = F.when(x <= g["hi"], a["up"] * (g["k"] - x + 1) * (g["n"] - x + 1) / (x * F.greatest(g["r"] + x, F.lit(1.0))))
            down = F.when(y >= g["lo"], a["down"] * (y + 1) * (g["r"] + y + 1) / ((g["k"] - y) * (g["n"] - y)))
            return up.otherwise(F.lit(0.0)), down.otherwise(F.lit(0.0))

        def add(a, t):
            up, down = grow(a, t)
            return let(F.struct(up.alias("up"), down.alias("down")), lambda w: F.struct(
                w["up"].alias("up"), w["down"].alias("down"), (a["sum"] + w["up"] + w["down"]).alias("sum")))

        def find(goal):
            def step(a, t):
                up, down = grow(a, t)

                def choose(w):
                    got = (F.when(a["x"].isNotNull(), a["x"])
                           .when((w["up"] > 0) & (a["sum"] + w["up"] > goal), g["mode"] + t)
                           .when((w["down"] > 0) & (a["sum"] + w["up"] + w["down"] > goal), g["mode"] - t))
                    return F.struct(w["up"].alias("up"), w["down"].alias("down"),
                                    (a["sum"] + w["up"] + w["down"]).alias("sum"), got.alias("x"))
                return let(F.struct(up.alias("up"), down.alias("down")), choose)
            return step

        one = [F.lit(1.0).alias("up"), F.lit(1.0).alias("down"), F.lit(1.0).alias("sum")]
        whole = F.aggregate(g["steps"], F.struct(*one), add)["sum"]
        return let(g["u"] * whole, lambda goal: F.coalesce(F.aggregate(
            g["steps"], F.struct(*one, F.when(goal < 1.0, g["mode"]).alias("x")), find(goal))["x"], g["mode"]))

    return let(given, draw)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(key, shard, q): the block quotas (key, q) split among ``shards`` shards (a power of two)."""
    def draw(acc, s):
        u = F.pmod(F.xxhash64(F.lit(seed), "node", "half", s["key"]), F.lit(1 << 52)).cast("double") / float(1 << 52)
        x = F.when(acc["n"] > 0, hypergeometric(s["q"], acc["total"], acc["n"], u)).otherwise(F.lit(0).cast("long"))
        return let(x, lambda y: F.struct(
            (acc["total"] - s["q"]).alias("total"), (acc["n"] - y).alias("n"), F.concat(acc["out"], F.array(y)).alias("out")))

    half_of_all = F.floor(F.col("total") / 2).cast("long").alias("n")
    left = F.aggregate("qs", F.struct("total", half_of_all, F.array().cast("array<bigint>").alias("out")), draw)["out"]
    one = F.col("z.qs.key").alias("key")
    children = F.array(F.struct((F.col("node") * 2).alias("node"), one, F.col("z.left").alias("q")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), one, (F.col("z.qs.q") - F.col("z.left")).alias("q")))
    level = quotas.select(F.lit(0).alias("node"), "key", "q")
    while shards > 1:
        shards //= 2
        node = level.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "q"))).alias("qs"), F.sum("q").alias("total"))
        node = node.withColumn("half", F.lit(shards)).withColumn("left", left)
        both = node.select("node", F.explode(F.arrays_zip("qs", "left")).alias("z"))
        level = both.select(F.explode(children).alias("c")).select("c.*")
    return level.select("key", F.col("node").alias("shard"), "q")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), shards: int = 16, seed: int = 42,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Column | None = None) -> DataFrame:
    """Per row: id, source, size, source_size, target and ``parts``, an array of (shard, place, epoch, block, start, words): ``words``
    words from word ``start`` of the text go to ``shard``, ordered there by ``place``; see the module's text. ``carry``: a value of the row
    that comes back as the column ``carried``, for rows that their id does not find again."""
    spark: SparkSession = docs.sparkSession
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    scratch = Scratch(spark, "mixing")
    # 'a' before a source and 'z' for null keep code point order with null last
    key = F.coalesce(F.concat(F.lit("a"), F.col(source_col)), F.lit("z"))
    more = [] if carry is None else ["carried"]
    sizes = scratch.table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"),
                                      n_words(F.col(text_col)).alias("size"), *([] if carry is None else [carry.alias("carried")])))
    per = source_targets(scratch, sizes, list(weights))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.ceil(F.col("source_size") / BLOCKS_AT_LEAST))).cast("long")
    per = (per.withColumn("block", block).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
           .withColumn("q", F.least(F.round(F.col("target") / F.col("block")).cast("long"), F.col("n_blocks") * MAX_EPOCHS)))
    per = scratch.table(per)
    split = split_quotas(per.select("key", "q"), shards, seed)
    ends = split.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "q"))).alias("s"))  # one entry per shard
    upto = F.transform("s", lambda x, i: F.aggregate(F.slice("s", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["q"]))
    per = scratch.table(per.join(ends.select("key", upto.alias("upto")), "key", "left"))
    n_docs = per.agg(F.sum("n_docs")).first()[0] or 0
    bits = 0
    while (BUCKET_ROWS << bits) < n_docs:
        bits += 1
    s = sizes.withColumn("o", F.xxhash64(F.lit(seed), "id", "size"))
    s = s.withColumn("bucket", F.shiftrightunsigned("o", 64 - bits) if bits else F.lit(0).cast("long"))
    offsets = s.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    offsets = offsets.select("key", "bucket", (F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")).alias("off"))
    inside = Window.partitionBy("key", "bucket").orderBy("o", "id", "size", *[F.xxhash64(c) for c in more]).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("at", F.sum("size").over(inside) - F.col("size")).join(offsets, ["key", "bucket"])
    s = s.withColumn("at", F.col("at") + F.col("off")).select("id", "source", "key", "size", "at", *more)
    s = s.join(per.select("key", "source_size", "target", "block", "n_blocks", "q", "upto"), "key")
    prime = F.when(F.col("n_blocks") % PRIMES[0] != 0, PRIMES[0]).otherwise(PRIMES[1])

    def draws(b):
        rank = (b * prime) % F.col("n_blocks")
        begin = F.greatest(F.col("at"), b * F.col("block"))
        end = F.least(F.col("at") + F.col("size"), (b + 1) * F.col("block"))

        def part(e):
            d = rank + e * F.col("n_blocks")
            shard = F.size(F.filter("upto", lambda x: x <= d))
            return F.when(d < F.col("q"), F.struct(
                shard.alias("shard"), F.xxhash64(F.lit(seed), shard, "key", b, e).alias("place"), e.cast("int").alias("epoch"),
                b.alias("block"), (begin - F.col("at")).alias("start"), (end - begin).alias("words")))
        return F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(MAX_EPOCHS - 1).cast("long")), part), lambda x: x.isNotNull())

    blocks = F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")))
    none = F.array().cast("array<struct<shard:int,place:bigint,epoch:int,block:bigint,start:bigint,words:bigint>>")
    parts = F.when(F.col("size") > 0, F.flatten(F.transform(blocks, draws))).otherwise(none)
    return s.select("id", "source", "size", "source_size", "target", parts.alias("parts"), *more).withColumnRenamed("id", id_col)


def taken(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["words"])


def shard_rows(mixed: DataFrame, docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: one row (shard, place, id, epoch, words of the text) per drawn part, shuffled inside its shard. Ids must be distinct."""
    p = mixed.select(id_col, F.explode("parts").alias("p"))
    word = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    p = p.join(docs.select(id_col, text_col), id_col)
    p = p.select(F.col("p.shard").alias("shard"), F.col("p.place").alias("place"), id_col, F.col("p.epoch").alias("epoch"),
                 F.array_join(F.slice(word, (F.col("p.start") + 1).cast("int"), F.col("p.words").cast("int")), " ").alias(text_col))
    return p.repartition(shards, "shard", "place").sortWithinPartitions("shard", "place", id_col)
