"""Language-model scores of texts: a smoothed word base and online logistic mixing of hashed-context bit predictors.

A text's bytes, then an end mark, become binary decisions: bytes are ranked by how often they follow the two bytes before, and the rank is
spelled by a Huffman code (one tree, a node of it is a decision). For each decision:

1. Three predictors look up its place in hashed tables, by the last 3 and 4 bytes and by the word so far (its last 8 bytes).
   Their values are log odds from counts over all training texts; a place never counted gives 0.
2. A mixer adds them with weights picked by a gate (which of the two longer contexts was ever counted, first decision of a byte or later).
   The weights start alike for every text and learn online: after each block of the text (``BLOCK`` bytes, the first ones shorter) they
   take a step along the block's gradient of coding cost.
3. A refinement adds a correction picked by the mixed log odds, learned the same way. The result is the decision's probability.

The total cost in bits gives the text's log probability and bits a byte. A text's score depends on the training texts and itself only,
not on the rows beside it or the partitions.

Training is sums alone: counts of words and byte triples, then of the hashed places, by tasks and merged by region of a table. A table has
``2**MOST_BITS`` places at most, fewer for small corpora; words beyond the ``HEAD`` most frequent ones meet their counts in a join.
Words are told apart by 64-bit digests (that any two of a billion words share one has a probability of 3%).

Nulls: a null text is empty and so only an end; a null id has the text '' and is held out. Repeated rows count and are scored each. Without
training texts every byte costs what a code without counts gives, and no word is known. An empty table gives no rows. Long texts are
scored in pieces that carry their weights along. Only the two named columns are read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabml.llm import textnum as T
from tabml.llm.store import Scratch

END = 0xFF  # never part of UTF-8
LOOKBACK = 8
#: Tables: by the last 3 and 4 bytes and by the word so far.
TABLES = 3
LEAST_BITS, MOST_BITS, PLACE_BYTES = 14, 22, 32
REGION = 14
COUNT_BYTES, COUNT_TASKS = 1 << 26, 1 << 16
HEAD, LEAD = 1 << 19, 20
#: Log odds are kept in steps of 1 / STEPS.
STEPS = 16
GATES, CELLS = 8, 25
BLOCK = 1024
#: Bytes scored at a time, and bytes of texts side by side.
TOGETHER, SIDE_BYTES = 1 << 14, 1 << 21
#: Start weight of every predictor; sizes of a step of the weights and of the corrections; events by which a small block's step is damped.
START, RATE, REFINE, DAMP = 0.35, 2.0, 1.0, 24.0
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32, END]] = True
_MULT = [np.uint64(m) for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass
class Codes:
    """Decisions of a byte: its rank after the two bytes before (row ``of[pair]`` of ranks), and the rank's path in the tree, at
    start[rank] .. start[rank] + length[rank] of salt (of the node), bit (0.0 or 1.0) and first (GATES // 2 on the first decision)."""

    of: np.ndarray
    ranks: np.ndarray
    start: np.ndarray
    length: np.ndarray
    salt: np.ndarray
    bit: np.ndarray
    first: np.ndarray

    def rank(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        pair = (x[at - 2].astype(np.int32) << 8) | x[at - 1]
        return self.ranks.take((self.of.take(pair) << 8) | x[at])

    def paths(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into rank, index into the path tables) of every decision, and the number of decisions of each rank."""
        n = self.length.take(rank)
        total = np.cumsum(n)
        of = np.repeat(np.arange(len(rank)), n)
        return of, np.arange(len(of)) + (self.start.take(rank) - total + n).take(of), n


def codes(followers: dict[int, list[int]], mass: dict[int, int]) -> Codes:
    """followers: bytes seen after each pair, most frequent first; mass: how often each rank was coded. Other bytes of a pair, and pairs never seen,
    follow the order of the bytes themselves."""
    pairs = sorted(followers)
    of = np.zeros(1 << 16, dtype=np.int32)
    of[pairs] = np.arange(1, len(pairs) + 1)
    ranks = np.empty((len(pairs) + 1, 256), dtype=np.uint8)
    ranks[0] = np.arange(256)
    for i, p in enumerate(pairs, 1):
        seen = followers[p]
        order = np.r_[np.array(seen, dtype=np.int64), np.setdiff1d(np.arange(256), seen)]
        ranks[i, order] = np.arange(256)
    heap = [(mass.get(r, 0) * 256 + 1, r) for r in range(256)]
    heapq.heapify(heap)
    parent, side = [0] * 511, [0] * 511
    for new in range(256, 511):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = new
        side[j] = 1
        heapq.heappush(heap, (a + b, new))
    node, bit, length = [], [], []
    for s in range(256):
        up = []
        while s != 510:
            up.append((parent[s], side[s]))
            s = parent[s]
        node += [x for x, _ in up[::-1]]
        bit += [x for _, x in up[::-1]]
        length.append(len(up))
    length = np.array(length, dtype=np.int64)
    start = np.cumsum(length) - length
    first = np.zeros(len(node), dtype=np.int64)
    first[start] = GATES // 2
    return Codes(of, ranks.ravel(), start, length, T.mix(np.array(node, dtype=np.uint64), 11).astype(np.uint32), np.array(bit, dtype=np.float32), first)


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Kept form (int8) of the log odds of a one after these counts."""
    return np.clip(np.rint(STEPS * np.log((ones + 0.4) / (zeros + 0.4))), -127, 127).astype(np.int8)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with LOOKBACK end marks before each row and after the last, place of each row's first byte)."""
    rows = len(offsets) - 1
    x = np.full(len(data) + LOOKBACK * (rows + 1), END, dtype=np.uint8)
    first = offsets[:-1] + LOOKBACK * np.arange(1, rows + 1)
    if 64 * rows < len(data):  # long rows one by one, short ones all at once
        for a, b, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist()):
            x[at: at + b - a] = data[a:b]
    else:
        x[np.arange(len(data)) + np.repeat(LOOKBACK * np.arange(1, rows + 1), np.diff(offsets))] = data
    return x, first


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[T.Words, np.ndarray]:
    """(words of the rows, their digests with A-Z lower-cased)."""
    upper = (data - np.uint8(65)) < 26
    w = T.words(data + (upper.view(np.uint8) << 5), offsets)
    return w, w.hashes(lower=False)


def word_shifts(x: np.ndarray) -> np.ndarray:
    """For each place the bits by which the 8 bytes before shrink to the word so far; two bytes at least."""
    place = np.arange(len(x), dtype=np.int32)
    gap = np.maximum.accumulate(np.where(_SPACE.take(x), place, 0))
    out = np.zeros(len(x), dtype=np.uint8)
    out[1:] = 64 - 8 * np.clip(place[:-1] - gap[:-1], 2, LOOKBACK)
    return out


def before(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes before each place as one number, the nearest byte highest."""
    return np.ndarray((len(x) - 7,), dtype="<u8", buffer=x.data, strides=(1,))[at - LOOKBACK]


def context(table: int, key: np.ndarray) -> np.ndarray:
    """Hashes (uint32) of a table's contexts."""
    key = key + np.uint64(1)
    key *= _MULT[table]
    key >>= np.uint64(32)
    return key.astype(np.uint32)


def contexts(x: np.ndarray, at: np.ndarray, shifts: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts of the places ``at``, one array for each table."""
    last = before(x, at)
    return [context(i, k) for i, k in enumerate((last >> np.uint64(40), last >> np.uint64(32), last >> shifts.take(at).astype(np.uint64)))]


def tallied(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each)."""
    key = np.sort(key)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[new], np.diff(np.r_[new, len(key)])


def coded(offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of all bytes and ends of padded rows, in order."""
    n = np.diff(offsets) + 1
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _tally(values: list[np.ndarray], kind: int) -> pa.RecordBatch:
    key, n = np.unique(np.concatenate(values), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 words by digest, 1 coded bytes with the two before, 2 number of texts (key 0) and of their bytes (key 1)."""
    rows, size = 0, 0
    held, many = [], 0
    triples, seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        data, off = T.texts(b.column("text"))
        rows += b.num_rows
        size += len(data)
        for lo, hi in T.slices(off):
            d, o = data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
            x, first = padded(d, o)
            wide = x.astype(np.int32)
            key, n = tallied(((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:])[coded(o, first) - 2])
            triples, at = np.unique(np.r_[triples, key], return_inverse=True)
            seen = np.bincount(at, np.r_[seen, n]).astype(np.int64)
            held.append(words(d, o)[1])
            many += len(held[-1])
            if many >= 1 << 21:
                yield _tally(held, 0)
                held, many = [], 0
    if many:
        yield _tally(held, 0)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.ones(len(triples), np.int32), [2, 2]].astype(np.int32)), pa.array(np.r_[triples, 0, 1]),
                                          pa.array(np.r_[seen, rows, size].astype(np.int64))], ["kind", "key", "n"])


def _place_counts(shared, bits: int):
    """Counts of zeros and ones of each hashed place, one compressed row for each region that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Codes = shared.value
        mask = np.uint32((1 << bits) - 1)
        counts = np.zeros((TABLES, 2 << bits), dtype=np.uint32)
        any_ = False

        def put(places: np.ndarray, base: np.ndarray, rank: np.ndarray, n: np.ndarray) -> None:
            of, path, _ = c.paths(rank)
            place = (base.take(of) ^ c.salt.take(path)) & mask
            np.add.at(places, (place.astype(np.int64) << 1) | (c.bit.take(path) > 0), n.astype(np.uint32).take(of))

        for b in batches:
            data, off = T.texts(b.column("text"))
            for lo, hi in T.slices(off, 1 << 21):
                any_ = True
                o = off[lo: hi + 1] - off[lo]
                x, first = padded(data[off[lo]: off[hi]], o)
                at, shifts = coded(o, first), word_shifts(x)
                for i in range(0, len(at), 1 << 21):
                    here = at[i: i + (1 << 21)]
                    last = before(x, here)
                    # equal cases are counted at once: by the 4 bytes before and the byte, by the word so far and the byte's rank
                    near, n = tallied(((last >> np.uint64(24)) & np.uint64(0xFFFFFFFF00)).view(np.int64) | x[here])
                    pair = ((near >> 16) & 0xFF00) | (near >> 32)
                    rank, key = c.ranks.take((c.of.take(pair).astype(np.int64) << 8) | (near & 255)), (near >> 8).view(np.uint64)
                    put(counts[0], context(0, key >> np.uint64(8)), rank, n)
                    put(counts[1], context(1, key), rank, n)
                    word, n = tallied((context(2, last >> shifts.take(here).astype(np.uint64)).astype(np.int64) << 8) | c.rank(x, here))
                    put(counts[2], (word >> 8).astype(np.uint32), word & 255, n)
        if not any_:
            return
        width = 2 << min(bits, REGION)
        for t, places in enumerate(counts):
            for r in range(len(places) // width):
                part = places[r * width: (r + 1) * width]
                most = part.max()
                if most:
                    raw = part.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([r], pa.int32()), pa.array([raw.itemsize], pa.int32()),
                                                      pa.array([zlib.compress(raw.tobytes(), 1)], pa.binary())], ["tab", "region", "width", "counts"])
    return run


def _merge_places(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for w, raw in zip(b.column("width").to_pylist(), b.column("counts")):
            got = np.frombuffer(zlib.decompress(raw.as_py()), dtype=f"u{w}")
            total = np.zeros(len(got), dtype=np.int64) if total is None else total
            total += got
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                                      pa.array([log_odds(total[::2], total[1::2]).tobytes()], pa.binary())], ["tab", "region", "odds"])


@dataclass
class Tables:
    """What goes to every task: codes, log odds of the hashed tables, the HEAD most frequent words (digests ascending, as unsigned
    numbers) with their counts, and where those with each leading LEAD bits begin."""

    codes: Codes
    odds: np.ndarray
    bits: int
    head: np.ndarray
    head_count: np.ndarray
    head_start: np.ndarray

    def counts(self, digest: np.ndarray) -> np.ndarray:
        """Count of each word (uint64 digests); 0 for those not in the head."""
        lead = (digest >> np.uint64(64 - LEAD)).astype(np.int64)
        at, stop = self.head_start.take(lead), self.head_start.take(lead + 1)
        out = np.zeros(len(digest))
        live = np.flatnonzero(at < stop)
        at, stop = at[live], stop[live]
        while len(live):
            hit = self.head.take(at) == digest.take(live)
            out[live[hit]] = self.head_count.take(at[hit])
            at = at + 1
            go = ~hit & (at < stop)
            live, at, stop = live[go], at[go], stop[go]
        return out


def tables(c: Codes, odds: np.ndarray, bits: int, words: np.ndarray, counts: np.ndarray) -> Tables:
    """words: digests of the head in any order."""
    words = words.astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    start = np.searchsorted(words >> np.uint64(64 - LEAD), np.arange((1 << LEAD) + 1, dtype=np.uint64)).astype(np.int32)
    return Tables(c, odds, bits, words, counts.astype(np.float64)[order], start)


@dataclass
class Model:
    tables: Tables
    words: DataFrame  # (key, n) of words not in the head
    texts: int        # training texts, which is the count of the end token
    tokens: int       # N
    distinct: int     # V


def fit(train: DataFrame, text_col: str = "text") -> Model:
    """Counts of all rows of ``train``, read twice."""
    spark: SparkSession = train.sparkSession
    scratch = Scratch(spark, "lm")
    rows = train.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = scratch.table(counted)
    facts = {r["key"]: r["n"] for r in counted.where("kind = 2").collect()}
    texts, size = facts.get(0, 0), facts.get(1, 0)
    triples = counted.where("kind = 1").select(F.shiftright("key", 8).alias("pair"), F.col("key").bitwiseAND(255).alias("byte"), "n")
    triples = triples.withColumn("rank", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("n"), "byte")) - 1)  # 256 rows a pair at most
    mass = {r["rank"]: r["n"] for r in triples.groupBy("rank").agg(F.sum("n").alias("n")).collect()}
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "byte"))), lambda x: x["byte"].cast("int"))
    followers = {r["pair"]: r["bytes"] for r in triples.groupBy("pair").agg(order.alias("bytes")).collect()}  # 65,536 rows at most
    words = counted.where("kind = 0").select("key", "n", F.floor(F.log2("n") * 4).alias("level"))
    levels = sorted(words.groupBy("level").agg(F.count("*").alias("many"), F.sum("n").alias("n")).collect(), key=lambda r: -r["level"])
    have, least = 0, 1 << 20
    for r in levels:  # a few rows for each doubling of a count
        have += r["many"]
        if have > HEAD:
            break
        least = r["level"]
    head = words.where(F.col("level") >= least).select("key", "n").toArrow()  # HEAD rows at most
    spelled = codes(followers, mass)
    bits = min(MOST_BITS, max(LEAST_BITS, (size // PLACE_BYTES).bit_length()))
    tasks = max(1, min(COUNT_TASKS, -(-size // COUNT_BYTES)))
    shared = spark.sparkContext.broadcast(spelled)
    places = rows.coalesce(tasks).mapInArrow(_place_counts(shared, bits), "tab int, region int, width int, counts binary")
    merged = places.groupBy("tab", "region").applyInArrow(_merge_places, "tab int, region int, odds binary").collect()  # TABLES * 2**MOST_BITS bytes at most
    odds = np.zeros((TABLES, 1 << bits), dtype=np.int8)
    step = 1 << min(bits, REGION)
    for r in merged:
        odds[r["tab"], r["region"] * step: (r["region"] + 1) * step] = np.frombuffer(r["odds"], dtype=np.int8)
    total, distinct = sum(r["n"] for r in levels), sum(r["many"] for r in levels)
    return Model(tables(spelled, odds, bits, head["key"].to_numpy(), head["n"].to_numpy()), words.where(F.col("level") < least).select("key", "n"), texts, total + texts, distinct + (texts > 0))


def _squash(odds: np.ndarray) -> np.ndarray:
    out = np.negative(odds)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Mixer:
    """Weights and corrections of ``rows`` texts that are scored side by side."""

    def __init__(self, t: Tables, rows: int):
        self.t = t
        self.weights = np.full((TABLES, rows * GATES), START, dtype=np.float32)
        self.corrections = np.zeros(rows * CELLS, dtype=np.float32)
        self.bits = np.zeros(rows)

    def block(self, x: np.ndarray, shifts: np.ndarray, at: np.ndarray, row: np.ndarray) -> None:
        """Score the bytes at places ``at`` of texts ``row`` (ascending) with the weights as they are, then learn from them."""
        t, c = self.t, self.t.codes
        of, path, n = c.paths(c.rank(x, at))
        salt, bit, mask = c.salt.take(path), c.bit.take(path), np.uint32((1 << t.bits) - 1)
        kept = [table.take((base.take(of) ^ salt) & mask) for table, base in zip(t.odds, contexts(x, at, shifts))]
        cell = (row * GATES).take(of) + c.first.take(path)
        cell += (kept[1] != 0).view(np.uint8) | ((kept[2] != 0).view(np.uint8) << 1)
        odds = [k * np.float32(1 / STEPS) for k in kept]
        mixed = self.weights[0].take(cell)
        mixed *= odds[0]
        for w, o in zip(self.weights[1:], odds[1:]):
            part = w.take(cell)
            part *= o
            mixed += part
        np.clip(mixed, -12, 12, out=mixed)
        step = (row * CELLS + CELLS // 2).take(of) + np.rint(mixed).astype(np.int64)
        final = np.clip(mixed + self.corrections.take(step), -14, 14)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # of each text's bytes in the block
        begin = (np.cumsum(n) - n)[first]
        chance = _squash(final)
        texts = row[first]
        self.bits[texts] -= np.add.reduceat(np.log2(np.abs(1 - bit - chance)), begin, dtype=np.float64)
        size = np.diff(np.r_[begin, len(of)])
        rate = np.ones(len(self.bits))
        rate[texts] = 1 / (size + DAMP)
        miss = bit - _squash(mixed)
        each = np.repeat(rate * RATE, GATES)
        for w, o in zip(self.weights, odds):
            w += (each * np.bincount(cell, miss * o, len(w))).astype(np.float32)
        self.corrections += (np.repeat(rate * REFINE, CELLS) * np.bincount(step, bit - chance, len(self.corrections))).astype(np.float32)


def ends_of_blocks(longest: int) -> list[int]:
    """0, 32, doubled up to BLOCK, then every BLOCK."""
    out = [0, *(1 << i for i in range(5, BLOCK.bit_length() - 1))]
    return [x for x in out if x < longest] + list(range(BLOCK, longest, BLOCK)) + [longest]


def text_bits(t: Tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cost in bits of each row and its end."""
    mixer = Mixer(t, len(offsets) - 1)
    if len(offsets) == 2 and len(data) > T.SLICE_BYTES:  # one long text, by pieces that end where blocks do
        marks = np.full(LOOKBACK, END, dtype=np.uint8)
        for lo in range(0, len(data) + 1, T.SLICE_BYTES):
            x = np.concatenate([data[lo - LOOKBACK: lo] if lo else marks, data[lo: lo + T.SLICE_BYTES], marks[: 1 if lo + T.SLICE_BYTES > len(data) else 0]])
            shifts = word_shifts(x)
            for a, b in _spans(ends_of_blocks(len(x) - LOOKBACK) if not lo else list(range(0, len(x) - LOOKBACK, BLOCK)) + [len(x) - LOOKBACK]):
                mixer.block(x, shifts, np.arange(LOOKBACK + a, LOOKBACK + b), np.zeros(b - a, dtype=np.int64))
        return mixer.bits
    x, first = padded(data, offsets)
    shifts, n = word_shifts(x), np.diff(offsets) + 1
    for a, b in _spans(ends_of_blocks(int(n.max()))):
        whole = np.flatnonzero(n > a)
        size = np.cumsum(np.minimum(n[whole], b) - a)
        cuts = [0, *np.flatnonzero(np.diff(size // TOGETHER)) + 1, len(whole)]
        for live in (whole[i:j] for i, j in _spans(cuts)):
            many = np.minimum(n[live], b) - a
            row = np.repeat(live, many)
            mixer.block(x, shifts, np.arange(len(row)) + np.repeat(first[live] + a - (np.cumsum(many) - many), many), row)
    return mixer.bits


def _spans(ends: list[int]) -> Iterator[tuple[int, int]]:
    return zip(ends, ends[1:])


_SCORED = "n_tokens long, head_known long, head_sum double, bits double, n_bytes long, tail array<long>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = shared.value
        for b in batches:
            data, off = T.texts(b.column("text"))
            for lo, hi in T.slices(off, SIDE_BYTES):
                d, o = data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
                rows = hi - lo
                w, digest = words(d, o)
                count = t.counts(digest)
                known = count > 0
                part = np.log10(count + 0.1) * known
                tail = np.flatnonzero(~known)
                ends = np.searchsorted(tail, w.first)
                yield pa.RecordBatch.from_arrays([
                    b.column("id").slice(lo, rows), b.column("out").slice(lo, rows), pa.array(np.diff(w.first) + 1),
                    pa.array(np.bincount(w.row, known, rows).astype(np.int64)), pa.array(np.bincount(w.row, part, rows).astype(np.float64)),
                    pa.array(text_bits(t, d, o)), pa.array(np.diff(o)), pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(digest[tail].view(np.int64)))],
                    ["id", "held_out", "n_tokens", "head_known", "head_sum", "bits", "n_bytes", "tail"])
    return run


def score(docs: DataFrame, model: Model, out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out (``out``), n_tokens, n_known, train_tokens, base_score, score (both log10), n_bytes, bits_per_byte (of the
    text's bytes, its end included in the cost; null for an empty text)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model.tables)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), out.alias("out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(shared), f"id {kind}, held_out boolean, {_SCORED}").withColumn("row", F.monotonically_increasing_id())
    scored = Scratch(spark, "lm").table(scored)
    tail = scored.select("row", F.explode("tail").alias("key")).join(model.words, "key", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("tail_sum"), F.count("n").alias("tail_known"))
    n = model.tokens
    each = math.log10(n + 0.1 * (model.distinct + 1))
    got = scored.join(tail, "row", "left")
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(math.log10(model.texts + 0.1)) - F.col("n_tokens") * F.lit(each)
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(model.texts > 0))
    return got.select("id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"),
                      (F.col("bits") * F.lit(-math.log10(2))).alias("score"), "n_bytes",
                      F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def held_out(doc_id: Column) -> Column:
    """Every tenth row by digest of its id; a row without an id counts as held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
