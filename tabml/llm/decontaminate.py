"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the positions of a run of ``SPAN`` lower-cased words; the others may differ. Every run of a test item and of a
text is hashed under every mask and equal hashes are joined; items of fewer words bring masks of their own length. A hit names a text, an item and a diagonal (text place minus item
place); the words of both are then compared along the diagonal, and an overlap counts where a stretch of ``MIN_OVERLAP`` words (the
whole item, if it is shorter) agrees in at least ``MIN_PCT`` percent of its places.

The texts' hashes first pass a Bloom filter of the items' hashes (``BLOOM_BITS`` bits, 1 MB whatever the benchmark holds; a fuller
filter only lets more hits through to the join), so only hits are shuffled: each with its region, the words up to ``REACH`` before
the first and after the last hit that lie close together.

Nulls: null or empty texts hold no overlap; null item texts and items without a word are never found. A text is known by a 64-bit digest, not
by its id, so rows with null or repeated ids are judged each by their own text; repeated items count once per id. Empty tables give no rows, or no overlap. Only the named
columns are read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.llm import textnum as T
from tabml.llm.store import Scratch

SPAN = 8
#: The last three hit what the others leave: by enumeration (tested) every accepted pattern of MIN_OVERLAP words, or of a whole item of SPAN words or more.
MASKS = ("11111111", "11101101", "11011011", "10110111", "11000111", "11011100", "01101011")
MIN_OVERLAP = 13
MIN_PCT = 80
REACH = 128
BLOOM_BITS = 23
PROBES = 4


def masks(lengths: list[int]) -> list[str]:
    """``MASKS``, and for items of these lengths under SPAN words masks of that length: the whole item, or each word left out if one may differ."""
    out = list(MASKS)
    for n in sorted(lengths):
        one = 100 * (n - 1) >= MIN_PCT * n
        out += ["1" * i + "0" + "1" * (n - 1 - i) for i in range(n)] if one else ["1" * n]
    return out


def seeds(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word place) of every full run under ``mask``."""
    n = len(h)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.flatnonzero(left >= len(mask))
    acc = np.full(len(at), 1000 + int("1" + mask, 2), dtype=np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            acc = T.mix(acc * np.uint64(6364136223846793005) + h[at + j])
    return acc, at


def probes(h: np.ndarray) -> list[np.ndarray]:
    g = T.mix(h, 77)
    return [((h >> np.uint64(5)) + np.uint64(i) * (g | np.uint64(1))) >> np.uint64(7) & np.uint64((1 << BLOOM_BITS) - 1) for i in range(PROBES)]


def _item_seeds(every: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in T.word_slices(b.column("text")):
                h = w.hashes()
                ids = b.column("item").slice(lo, hi - lo)
                many = np.diff(w.first)
                for m in every:
                    s, at = seeds(h, w.first, m)
                    own = (len(m) == SPAN) | (many[w.row[at]] == len(m))  # shorter masks are for items of their length only
                    s, at = s[own], at[own]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(w.row[at])), pa.array(s.view(np.int64)),
                                                      pa.array(at - w.first[w.row[at]])], ["item", "seed", "place"])
    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, w in T.word_slices(b.column("text")):
            h = w.hashes()
            yield pa.RecordBatch.from_arrays([b.column("item").slice(lo, hi - lo), pa.array(
                [h[x:y].tobytes() for x, y in zip(w.first[:-1], w.first[1:])], pa.binary())], ["item", "words"])


def _bloom_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.asarray(b.column("seed")).view(np.uint64)
        at = np.unique(np.concatenate(probes(h))) if len(h) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                          pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["cell", "bits"])


REGION = "row long, region long, start long, words binary, hits array<struct<seed:long,place:long>>"


def _find(bloom: np.ndarray, every: list[str]):
    def maybe(h: np.ndarray) -> np.ndarray:
        ok = np.arange(len(h))
        for i in range(PROBES):
            p = probes(h[ok])[i]
            ok = ok[(bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) == 1]
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.asarray(b.column("row"))
            for lo, hi, w in T.word_slices(b.column("text")):
                h = w.hashes()
                got = []
                for m in every:
                    s, at = seeds(h, w.first, m)
                    i = maybe(s)
                    got.append((s[i], at[i]))
                s, at = (np.concatenate(x) for x in zip(*got))
                if not len(s):
                    continue
                order = np.argsort(at, kind="stable")
                s, at = s[order], at[order]
                own = w.row[at]
                cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] - at[:-1] > REACH)])
                out = []
                for x, y in zip(cut, np.r_[cut[1:], len(at)]):
                    r = own[x]
                    begin, end = max(w.first[r], at[x] - REACH), min(w.first[r + 1], at[y - 1] + SPAN + REACH)
                    out.append((rows[lo + r], at[x] - w.first[r], begin - w.first[r], h[begin:end].tobytes(),
                                [{"seed": int(q), "place": int(p)} for q, p in zip(s[x:y].view(np.int64), at[x:y] - begin)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()),
                     pa.array([o[3] for o in out], pa.binary()),
                     pa.array([o[4] for o in out], pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int64())])))],
                    ["row", "region", "start", "words", "hits"])
    return run


def overlap(x: np.ndarray, y: np.ndarray, diagonal: int) -> tuple[int, int] | None:
    """Words [from, to) of x under stretches that agree with y along the diagonal, or None."""
    lo, hi = max(0, diagonal), min(len(x), diagonal + len(y))
    need = min(MIN_OVERLAP, len(y))
    if hi - lo < need:
        return None
    same = x[lo:hi] == y[lo - diagonal: hi - diagonal]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(100 * (sums[need:] - sums[:-need]) >= MIN_PCT * need)
    if not len(good):
        return None
    a, b = good[0], good[-1] + need
    inside = np.flatnonzero(same[a:b])
    return int(lo + a + inside[0]), int(lo + a + inside[-1] + 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, spans = [], []
        start, diag = b.column("start").to_pylist(), b.column("diagonal").to_pylist()
        for i, (x, y) in enumerate(zip(b.column("words"), b.column("item_words"))):
            got = overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), diag[i])
            if got:
                keep.append(i)
                spans.append((start[i] + got[0], start[i] + got[1]))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("item").take(at), pa.array([s[0] for s in spans], pa.int64()),
                                          pa.array([s[1] for s in spans], pa.int64())], ["row", "item", "start", "end"])


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def find_overlaps(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, item, start, end): words [start, end) of the texts with this ``text_digest`` overlap the item."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "decon")
    items = bench.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    words = items.mapInArrow(_item_words, "item long, words binary").withColumnRenamed("words", "item_words").distinct()
    many = words.select((F.octet_length("item_words") / 8).cast("int").alias("n")).where(f"n between 1 and {SPAN - 1}").distinct()
    every = masks([r["n"] for r in many.collect()])  # at most SPAN - 1 rows
    seed = scratch.table(items.mapInArrow(_item_seeds(every), "item long, seed long, place long"))
    cells = (seed.select("seed").mapInArrow(_bloom_places, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
             .toPandas())  # at most 2**17 rows
    bloom = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.uint64)
    bloom[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    text = F.col(f"`{text_col}`")
    rows = docs.select(text_digest(text).alias("row"), text.alias("text"))
    regions = scratch.table(rows.mapInArrow(_find(bloom, every), REGION))
    hits = regions.select("row", "region", F.explode("hits").alias("h")).select("row", "region", F.col("h.seed").alias("seed"), F.col("h.place").alias("p"))
    found = hits.join(seed, "seed").select("row", "region", "item", (F.col("p") - F.col("place")).alias("diagonal")).distinct()
    full = found.join(regions.select("row", "region", "start", "words").distinct(), ["row", "region"]).join(words, "item")
    return full.select("row", "item", "start", "words", "diagonal", "item_words").mapInArrow(_verify, "row long, item long, start long, end long")


def judged(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, contaminated, n_items, n_spans, items) per row of ``docs``, ``row`` being the whole row as a struct."""
    found = find_overlaps(docs, bench, text_col).distinct().groupBy("row")
    found = found.agg(F.count_distinct("item").alias("n_items"), F.count("*").alias("n_spans"), F.array_sort(F.collect_set("item")).alias("items"))
    found = Scratch(docs.sparkSession, "judged").table(found.withColumnRenamed("row", "digest"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_digest(F.col(f"`{text_col}`")).alias("digest"))
    got = whole.join(found, "digest", "left")
    return got.select("row", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_items, n_spans, items) of the rows whose text overlaps some item."""
    return judged(docs, bench, text_col).where("contaminated").select(F.col("row")[id_col].alias(id_col), "n_items", "n_spans", "items")
