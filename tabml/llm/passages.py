"""Substring dedup: near-duplicate passages by compact windows of token min-hashes.

A token is a run of ``RUN`` lower-cased words. Under each of ``HASHES`` hash functions a text's Cartesian tree (smallest hash on top)
groups all of its subsequences by their min-hash: a node c whose subtree is [l, r] stands for every [i, j] with l <= i <= c <= j <= r. Nodes
with fewer than ``LENGTH`` tokens are not needed; the others are exactly the minima of sliding windows of that length, and their
bounds are the nearest smaller such minima, so the tree is never built whole.

Equal texts are one class (the row with the smallest id stands for it; the other rows of the class repeat it whole). A window is the minimum of
the passages of ``LENGTH`` tokens that start in a range of places; these ranges are disjoint under one function, and an interval join of the ranges
of two functions gives the places where both agree with any text that holds the same passage: every pair of functions, and all
``HASHES`` together, make a key with the common interval of their windows. Only windows whose min-hash another window has go into that join.

Within a key the text with the smallest id (then the first place in it) is the hub and the others meet it first. As a key
holds two min-hashes of one passage, or all of them, passages made of frequent lines meet under the keys of their line sequence, not of one line.
A hub may hold another passage than two texts that share one, so what of a key's windows is not cut after that goes a second, exact way: of a
passage's ``LENGTH`` tokens at most ``SPARE`` may be missing in the other one, so that one holds at least one of the ``SPARE`` + 1 rarest.
Passages with more than ``SPARE`` tokens that have no earlier place end there. The earlier side is what is heard up to
``AROUND`` places off a token of a passage that has at most ``SPARE`` tokens of its own; of equal surroundings the first place speaks for all. Passages meet the
first place of each of their rarest tokens, then up to ``PLACES`` others, and then every other one. After the first place those end whose tokens that have an earlier
place are cut, all under one span (passages that begin shortly before a cut one or end shortly after it mostly are such): whatever text shares them, it shares
nothing else. That is linear in the copies, still in pairs where unlike passages share all their frequent tokens.
What a text and a hub have in common is joined to stretches of overlapping intervals and verified on the words: a token is shared if the
other passage has it, and a passage is a stretch of ``LENGTH`` tokens with at least ``SHARED_PCT`` percent shared (8/9 of two
equally long sequences is a Jaccard similarity of 0.8). Touching stretches are one span. The first text keeps its passage,
later ones lose it; a later repeat in the same text counts too.

A window reaches at most ``REACH`` tokens from its node (longer copies are tiled by the windows of other nodes).

Nulls: null, empty and short texts have no window, and lose nothing; null ids come last in order. Different texts under one id are told apart
(by 64-bit digests), equal rows with one id are one row: each keeps or loses the same. Ids are integers below 2**62. An empty
table gives no rows. Only the two named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabml.llm import textnum as T
from tabml.llm.store import Scratch

RUN = 5
WORDS = 50
LENGTH = WORDS - RUN + 1
HASHES = 4
SHARED_PCT = 89
SPARE = LENGTH - -(-SHARED_PCT * LENGTH // 100)
REACH = (1 << 12) - 1
HUB_STEP = 64
OFTEN = 1 << 12
AROUND = LENGTH + SPARE
PAIR_TOKENS = 1 << 16
PLACES = 8
BITS = np.arange(LENGTH)
FACTOR = 6364136223846793005
INVERSE = pow(FACTOR, -1, 1 << 64)
IDS_END = 1 << 62


def tokens(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, bounds per row); a row has words - RUN + 1 tokens, none if it is shorter."""
    h = w.hashes()
    count = np.diff(w.first)
    s, row = T.shingles(h, w.first, RUN)
    full = count[row] >= RUN
    s, row = s[full], row[full]
    return s, np.searchsorted(row, np.arange(len(w.first)))


def compact_windows(v: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, left, right) of every Cartesian-tree node with LENGTH tokens or more, rows apart."""
    n = len(v)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (v & ~low) | np.arange(n, dtype=np.uint64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    best = T.sliding_min(packed, LENGTH)
    best = best[np.arange(len(best)) + LENGTH <= end[: len(best)]]
    node = (best & low).astype(np.int64)
    node = node[np.r_[True, node[1:] != node[:-1]][: len(node)]]   # the minimum of a sliding window never moves back
    row = np.searchsorted(bounds, node, side="right") - 1
    val = packed[node]
    before, after = _nearest_smaller(val, row), len(node) - 1 - _nearest_smaller(val[::-1], row[::-1])[::-1]
    left = np.where(before >= 0, node[before] + 1, bounds[row])
    right = np.where(after < len(node), node[np.minimum(after, len(node) - 1)] - 1, bounds[row + 1] - 1)
    return node, left, right


def _nearest_smaller(val: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier value of the row that is smaller (-1: none). All between an index and the one it points to are larger, so it may jump on."""
    to = np.arange(-1, len(val) - 1)
    to[np.r_[True, row[1:] != row[:-1]][: len(row)]] = -1
    live = np.flatnonzero(to >= 0)
    while len(live := live[(to[live] >= 0) & (val[to[live]] > val[live])]):
        to[live] = to[to[live]]
    return to


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, d, win): key is the min-hash with the function in its low bits; win packs node, and its distance to left and right."""
    for b in batches:
        ids = np.asarray(b.column("d"))
        for lo, hi, w in T.word_slices(b.column("text")):
            s, bounds = tokens(w)
            for f in range(HASHES):
                node, left, right = compact_windows(T.mix(s, 300 + f), bounds)
                if not len(node):
                    continue
                row = np.searchsorted(bounds, node, side="right") - 1
                key = (T.mix(s[node], 400 + f) & ~np.uint64(HASHES - 1)) | np.uint64(f)
                win = ((node - bounds[row]) << 24) | (np.minimum(node - left, REACH) << 12) | np.minimum(right - node, REACH)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[lo:hi][row]), pa.array(win)], ["key", "d", "win"])


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # first and last start, key, left, right; disjoint and sorted


def meet(x: Runs, y: Runs, seed: int) -> Runs:
    """Interval join: the overlaps of the runs of x and y, with both keys mixed and the common interval."""
    lo, hi = np.searchsorted(y[1], x[0]), np.searchsorted(y[0], x[1], side="right")
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
    key = T.mix(x[2][i] * np.uint64(6364136223846793005) + y[2][j], seed)
    return (np.maximum(x[0][i], y[0][j]), np.minimum(x[1][i], y[1][j]), key, np.maximum(x[3][i], y[3][j]), np.minimum(x[4][i], y[4][j]))


def joint_keys(text: np.ndarray, key: np.ndarray, win: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, left, right) of every two functions' windows, and of all functions', that are minima of one passage. ``text`` is sorted."""
    kinds, row = np.unique(text, return_inverse=True)
    base = row.astype(np.int64) << 36
    node = win >> 24
    left, right = node - ((win >> 12) & REACH), node + (win & REACH)
    runs = []
    for f in range(HASHES):
        own = np.flatnonzero((key & (HASHES - 1)) == f)
        own = own[np.argsort(base[own] + node[own], kind="stable")]
        begin, end = np.maximum(left, node - LENGTH + 1)[own], np.minimum(right - LENGTH + 1, node)[own]
        runs.append((base[own] + begin, base[own] + end, key[own].view(np.uint64), base[own] + left[own], base[own] + right[own]))
    got = {(f, g): meet(runs[f], runs[g], 500 + f * HASHES + g) for f in range(HASHES) for g in range(f + 1, HASHES)}
    every = got[(0, 1)]
    for f in range(2, HASHES):
        every = meet(every, runs[f], 600 + f)
    key, left, right = (np.concatenate([r[c] for r in [*got.values(), every]]) for c in (2, 3, 4))
    low = (1 << 36) - 1
    return key.view(np.int64), kinds[left >> 36], left & low, right & low


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t, win) of a partition's windows sorted by text; win packs the interval's left end and width. A text may span batches."""
    held = [np.zeros(0, np.int64)] * 3

    def emit(cols):
        key, t, left, right = joint_keys(*cols)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(t), pa.array((left << 13) | (right - left))], ["key", "t", "win"])

    for b in batches:
        held = [np.concatenate([h, np.asarray(b.column(c))]) for h, c in zip(held, ("t", "key", "win"))]
        done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if done:
            yield emit([h[:done] for h in held])
            held = [h[done:] for h in held]
    if len(held[0]):
        yield emit(held)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens [lo, hi] of a text for each of its ranges, as the bytes of their hashes."""
    for b in batches:
        for x, y, w in T.word_slices(b.column("text")):
            s, bounds = tokens(w)
            out = []
            for i, (t, ranges) in enumerate(zip(b.column("t").slice(x, y - x).to_pylist(), b.column("ranges").slice(x, y - x).to_pylist())):
                for r in ranges:
                    p, q = bounds[i] + r["lo"], min(bounds[i] + r["hi"] + 1, bounds[i + 1])
                    if p < q:
                        out.append((t, r["lo"], r["hi"], s[p:q].tobytes()))
                if len(out) >= 1024:
                    yield _parts(out)
                    out = []
            yield _parts(out)


def _parts(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)] + [
        pa.array([o[3] for o in out], pa.binary())], ["t", "lo", "hi", "part"])


def shared_spans(a: np.ndarray, b: np.ndarray, same_text: int | None = None) -> list[tuple[int, int]]:
    """Token ranges [from, to) of a that near-duplicate b. ``same_text``: a's place minus b's, if both are of one text; a token
    is then shared only with an earlier place."""
    if len(a) < LENGTH:
        return []
    if same_text is None:
        hit = np.isin(a, b)
    else:
        kinds, where = np.unique(b, return_index=True)
        i = np.minimum(np.searchsorted(kinds, a), len(kinds) - 1)
        hit = (kinds[i] == a) & (where[i] < np.arange(len(a)) + same_text)
    sums = np.concatenate([[0], np.cumsum(hit)])
    good = np.flatnonzero(100 * (sums[LENGTH:] - sums[:-LENGTH]) >= SHARED_PCT * LENGTH)
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > LENGTH)
    out = []
    for x, y in zip(np.r_[0, cut + 1], np.r_[cut, len(good) - 1]):
        inside = np.flatnonzero(hit[good[x]: good[y] + LENGTH]) + good[x]
        out.append((int(inside[0]), int(inside[-1]) + 1))
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds per row) of a column of ``_slices``."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0]: off[-1]]
    return raw.view(np.uint64), (off - off[0]) >> 3


def spans_of_pairs(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, from, to): ``shared_spans`` of many pairs of two texts at once; pair i is a[a_ends[i]:a_ends[i + 1]] against the same of b."""
    n, m = np.diff(a_ends), np.diff(b_ends)
    own = np.arange(1, len(n) + 1, dtype=np.uint64) * np.uint64(FACTOR)
    pair = np.repeat(np.arange(len(n)), n)
    x, y = a ^ own[pair], np.sort(b ^ np.repeat(own, m))
    hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
    sums = np.concatenate([[0], np.cumsum(hit)])
    start = np.flatnonzero(np.arange(len(a)) + LENGTH <= a_ends[1:][pair])
    good = start[100 * (sums[start + LENGTH] - sums[start]) >= SHARED_PCT * LENGTH]
    if not len(good):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero((np.diff(good) > LENGTH) | (np.diff(pair[good]) > 0))
    begin, last = good[np.r_[0, cut + 1]], good[np.r_[cut, len(good) - 1]]
    places = np.flatnonzero(hit)
    which = pair[begin]
    s, e = places[np.searchsorted(places, begin)], places[np.searchsorted(places, last + LENGTH) - 1] + 1
    return which, s - a_ends[which], e - a_ends[which]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        i, lo, hub, hub_lo = (np.asarray(whole.column(c)) for c in ("id", "lo", "hub", "hub_lo"))
        (a, a_ends), (b, b_ends) = _flat(whole.column("part")), _flat(whole.column("hub_part"))
        ends = a_ends + b_ends
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIR_TOKENS, side="right")) - 1)
            got = [np.zeros((0, 3), np.int64)]
            for k in at + np.flatnonzero(i[at:to] == hub[at:to]):
                spans = shared_spans(a[a_ends[k]: a_ends[k + 1]], b[b_ends[k]: b_ends[k + 1]], int(lo[k] - hub_lo[k]))
                got.append(np.array([(k, s, e) for s, e in spans], np.int64).reshape(-1, 3))
            which, s, e = spans_of_pairs(a[a_ends[at]: a_ends[to]], a_ends[at: to + 1] - a_ends[at], b[b_ends[at]: b_ends[to]], b_ends[at: to + 1] - b_ends[at])
            two = i[at + which] != hub[at + which]
            got.append(np.column_stack([at + which[two], s[two], e[two]]))
            k, s, e = np.concatenate(got).T
            yield pa.RecordBatch.from_arrays([pa.array(i[k]), pa.array(lo[k] + s), pa.array(lo[k] + e + RUN - 1), pa.array(hub[k])], ["id", "start", "end", "source_id"])
            at = to


def _texts(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(t, d, id, n_rows): one row per distinct text. t orders texts: the smallest id, or a number past all ids if that is null or another text's."""
    texts = scratch.table(rows.groupBy("d").agg(F.min("id").alias("id"), F.count("*").alias("n_rows")))
    own = texts.where("id is not null").groupBy("id").agg(F.min("d").alias("own"))
    past = F.lit(IDS_END) + F.xxhash64("id", "d").bitwiseAND(F.lit((1 << 61) - 1))
    return scratch.table(texts.join(own, "id", "left").select(F.when(F.col("own") == F.col("d"), F.col("id")).otherwise(past).alias("t"), "d", "id", "n_rows"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, d, win): each once, and only those whose key has another one. A key may span batches."""
    last, out = None, False  # the last row, held until the next one is known; whether it is out already
    for b in batches:
        key, d, win = (np.asarray(b.column(c)) for c in ("key", "d", "win"))
        if last is not None:
            key, d, win = (np.r_[x, y] for x, y in zip(last, (key, d, win)))
        if not len(key):
            continue
        new = np.r_[True, (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (win[1:] != win[:-1])]
        key, d, win = key[new], d[new], win[new]
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        if last is not None and out:
            keep[0] = False
        out = bool(keep[-1]) or (len(key) == 1 and out)
        last = key[-1:], d[-1:], win[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, d, win)], ["key", "d", "win"])


def _found(scratch: Scratch, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(t, start, end, hub): words [start, end) of the text t near-duplicate a passage of the text hub, which comes first."""
    # one exchange of the windows: copies of a row and keys that no other window has end in it
    windows = rows.mapInArrow(_windows, "key long, d long, win long").repartition("key").sortWithinPartitions("key", "d", "win")
    shared = scratch.table(windows.mapInArrow(_shared, "key long, d long, win long"))
    met = shared.join(texts.select("t", "d"), "d").select("t", "key", "win")
    joint = scratch.table(met.repartition("t").sortWithinPartitions("t").mapInArrow(_joint, "key long, t long, win long"))
    scratch.drop(shared)
    hubs = joint.groupBy("key").agg(F.min(F.struct("t", "win")).alias("h"), F.count("*").alias("c")).where("c > 1")
    hubs = scratch.table(hubs.select("key", F.col("h.t").alias("hub"), F.col("h.win").alias("hub_win"), "c"))

    def left(c):
        return F.shiftright(c, 13)

    def right(c):
        return F.shiftright(c, 13) + F.col(c).bitwiseAND(F.lit((1 << 13) - 1))

    pairs = joint.join(hubs, "key").where("t <> hub or win <> hub_win").select(
        "t", left("win").alias("lo"), right("win").alias("hi"), "hub", left("hub_win").alias("hub_lo"), right("hub_win").alias("hub_hi"))
    # stretches of overlapping intervals of one text against one hub; none is shorter than LENGTH, so those that start in one step of it overlap
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    hub_ends = [F.min("hub_lo").alias("hub_lo"), F.max("hub_hi").alias("hub_hi")]
    pairs = pairs.groupBy("t", "hub", F.floor(F.col("lo") / LENGTH).alias("step")).agg(*ends, *hub_ends)
    before = Window.partitionBy("t", "hub").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("t", "hub").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("int"))
    pairs = pairs.withColumn("stretch", F.sum("new").over(upto)).groupBy("t", "hub", "stretch").agg(*ends, *hub_ends)
    # a hub's ranges in steps, so that their number grows with its text, not with its partners
    step = F.lit(HUB_STEP)
    pairs = scratch.table(pairs.select("t", "lo", "hi", "hub", (F.floor(F.col("hub_lo") / step) * step).alias("hub_lo"),
                                       (F.ceil((F.col("hub_hi") + 1) / step) * step).alias("hub_hi")))
    # places that can still meet others than the hub: under a key of two windows both have met
    crowded = joint.join(hubs.where("c > 2").select("key"), "key").select("t", left("win").alias("lo"), right("win").alias("hi"))
    crowded = crowded.groupBy("t", F.floor(F.col("lo") / LENGTH).alias("step")).agg(*ends)
    before = Window.partitionBy("t").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("t").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    crowded = crowded.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("int"))
    crowded = scratch.table(crowded.withColumn("stretch", F.sum("new").over(upto)).groupBy("t", "stretch").agg(*ends).drop("stretch"))
    scratch.drop(joint, hubs)
    found = scratch.table(_verified(scratch, rows, texts, pairs))
    return _others(scratch, rows, texts, crowded, found)


def _with_ranges(rows: DataFrame, texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(t, ranges, text) of the texts that have ranges (t, lo, hi)."""
    need = ranges.groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")).join(texts.select("t", "d", F.col("id").alias("first")), "t")
    return rows.join(need, (rows["d"] == need["d"]) & rows["id"].eqNullSafe(need["first"])).select("t", "ranges", "text")


def _verified(scratch: Scratch, rows: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(t, start, end, hub) of the pairs (t, lo, hi, hub, hub_lo, hub_hi), by their words."""
    need = pairs.select("t", "lo", "hi").unionByName(pairs.select(F.col("hub").alias("t"), F.col("hub_lo").alias("lo"), F.col("hub_hi").alias("hi")))
    parts = _with_ranges(rows, texts, need).mapInArrow(_slices, "t long, lo long, hi long, part binary")
    parts = scratch.table(parts.dropDuplicates(["t", "lo", "hi"]))
    hub_parts = parts.select(F.col("t").alias("hub"), F.col("lo").alias("hub_lo"), F.col("hi").alias("hub_hi"), F.col("part").alias("hub_part"))
    both = pairs.join(parts, ["t", "lo", "hi"]).join(hub_parts, ["hub", "hub_lo", "hub_hi"])
    return both.select(F.col("t").alias("id"), "lo", "part", "hub", "hub_lo", "hub_part").mapInArrow(
        _verify, "id long, start long, end long, source_id long").withColumnsRenamed({"id": "t", "source_id": "hub"})


def rare_seeds(n: np.ndarray, skip: np.ndarray) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Of a range whose tokens occur ``n`` times (0: nowhere else), the stretches [from, to) of passages that another place may
    hold, and for each the places of their rarest tokens. ``skip``: starts of passages that are cut already."""
    got = [(x, y, at[n[at] > 0]) for x, y, at, _, _ in _rarest(n, skip)]
    return [(x, y) for x, y, _ in got], [at for _, _, at in got]


def _starts(heard: np.ndarray) -> np.ndarray:
    """Starts of passages with at most SPARE tokens that are not heard."""
    sums = np.concatenate([[0], np.cumsum(~heard)])
    return sums[LENGTH:] - sums[:-LENGTH] <= SPARE


def _heard_ends(heard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last heard place of the passage at each start (past each other if it has none)."""
    places, start = np.r_[np.flatnonzero(heard), len(heard)], np.arange(len(heard))
    last = np.r_[-1, np.flatnonzero(heard)]
    return places[np.searchsorted(places, start)], last[np.searchsorted(last, start + LENGTH) - 1]


def settled(first: np.ndarray, last: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Passages whose heard tokens, from ``first`` to ``last``, one of the cut spans (in order and apart) covers: whatever other text holds such a
    passage, the words they share are cut already."""
    if not len(begin):
        return np.zeros(len(first), bool)
    at = np.searchsorted(begin, first, side="right") - 1
    return (at >= 0) & (stop[at] >= last + RUN)


def _rarest(n: np.ndarray, skip: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, places of the rarest tokens, the first start of a passage that counts on each place, all of them as bits from it) of each stretch."""
    if len(n) < LENGTH:
        return []
    good = np.flatnonzero(_starts(n > 0) & ~skip[: len(n) - LENGTH + 1])
    out = []
    for at in np.split(good, np.flatnonzero(np.diff(good) > LENGTH) + 1) if len(good) else []:
        rare = np.argpartition(np.lib.stride_tricks.sliding_window_view(n, LENGTH)[at], SPARE, axis=1)[:, : SPARE + 1] + at[:, None]
        places, which = np.unique(rare, return_inverse=True)
        first, bits = np.full(len(places), len(n)), np.zeros(len(places), np.int64)
        which, start = which.ravel(), np.repeat(at, SPARE + 1)
        np.minimum.at(first, which, start)
        np.bitwise_or.at(bits, which, np.int64(1) << (start - first[which]))
        out.append((int(at[0]), int(at[-1]) + LENGTH, places, first, bits))
    return out


def _range_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tok, t, p, lo, hi): the token at each place p of a text's ranges."""
    for b in batches:
        for x, y, w in T.word_slices(b.column("text")):
            s, bounds = tokens(w)
            s = s.view(np.int64)
            for i, (t, ranges) in enumerate(zip(b.column("t").slice(x, y - x).to_pylist(), b.column("ranges").slice(x, y - x).to_pylist())):
                for r in ranges:
                    got = s[bounds[i] + r["lo"]: min(bounds[i] + r["hi"] + 1, bounds[i + 1])]
                    p = np.arange(len(got)) + r["lo"]
                    cols = [got, np.full(len(got), t), p, np.full(len(got), r["lo"]), np.full(len(got), r["hi"])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["tok", "t", "p", "lo", "hi"])


def _heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (tok, t, p), those whose token has another place: with n, their number up to OFTEN, negative at the first place.
    A token may span batches; no more than OFTEN of its rows are held."""
    names = ["tok", "t", "p", "lo", "hi"]
    held, over = [np.zeros(0, np.int64)] * 5, False  # the last token's rows; over: OFTEN of them and more are out

    def emit(cols, n, first):
        keep = n > 1
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols] + [pa.array(np.where(first, -n, n)[keep])], [*names, "n"])

    for b in batches:
        new = [np.asarray(b.column(c)) for c in names]
        if not len(new[0]):
            continue
        if over:  # the token that is out already goes on
            m = int(np.searchsorted(new[0], over_tok, side="right"))
            if m:
                yield emit([c[:m] for c in new], np.full(m, OFTEN), np.zeros(m, bool))
            new = [c[m:] for c in new]
            over = not len(new[0])
        held = [np.r_[h, c] for h, c in zip(held, new)]
        if not len(held[0]):
            continue
        done = int(np.searchsorted(held[0], held[0][-1]))
        if len(held[0]) - done >= OFTEN:
            over, over_tok, done = True, held[0][-1], len(held[0])
        if done:
            at = np.flatnonzero(np.r_[True, held[0][1:done] != held[0][: done - 1]])
            n = np.minimum(np.diff(np.r_[at, done]), OFTEN)
            first = np.zeros(done, bool)
            first[at] = True
            yield emit([h[:done] for h in held], np.repeat(n, np.diff(np.r_[at, done])), first)
            held = [h[done:] for h in held]
    if len(held[0]):
        yield emit(held, np.full(len(held[0]), len(held[0])), np.arange(len(held[0])) == 0)


def _around(kind: np.ndarray, heard: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash, for each of the heard places ``at``, of the heard tokens up to AROUND places off, in order; one that repeats at once counts once."""
    place = np.flatnonzero(heard)
    kinds = kind[place]
    new = np.r_[True, kinds[1:] != kinds[:-1]][: len(kinds)]
    run = np.cumsum(new) - 1
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(int(new.sum()), f, np.uint64)]) for f in (FACTOR, INVERSE))
    sums = np.r_[np.uint64(0), np.cumsum(T.mix(kinds[new].view(np.uint64), 701) * up[:-1])]
    x = run[np.searchsorted(place, at - AROUND)]
    y = run[np.searchsorted(place, at + AROUND, side="right") - 1] + 1
    return (sums[y] - sums[x]) * down[x]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (t, lo, p, hi, tok, n) sorted by (t, lo, p), a text's cut spans first (lo -1, from p to hi): (tok, t, lo, hi, around, passages),
    the rarest tokens of the passages of the stretch [lo, hi] that are not cut, each with the first and last heard place of its passages, and with passages null the
    tokens of all passages that another text may hold, with [lo, hi] around them and what is heard there."""
    names = ["t", "lo", "p", "hi", "tok", "n"]
    held = [np.zeros(0, np.int64)] * 6

    def text(t, lo, p, hi, tok, n, out):
        spans = np.flatnonzero(lo == -1)
        begin = np.flatnonzero(np.r_[True, lo[1:] != lo[:-1]])
        for x, y in zip(begin, np.r_[begin[1:], len(lo)]):
            if lo[x] == -1 or y - x < LENGTH - SPARE:
                continue
            count, kind = np.zeros(hi[x] - lo[x] + 1, np.int64), np.zeros(hi[x] - lo[x] + 1, np.int64)
            count[p[x:y] - lo[x]], kind[p[x:y] - lo[x]] = n[x:y], tok[x:y]
            if len(count) < LENGTH:
                continue
            # as the earlier side: the tokens of every passage that can be another's, each with what is heard around it
            inside = np.zeros(len(count) + 1, np.int64)
            good = np.flatnonzero(_starts(count != 0))
            np.add.at(inside, good, 1)
            np.add.at(inside, good + LENGTH, -1)
            at = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & (count != 0))
            around = _around(kind, count != 0, at)
            _, one = np.unique(T.mix(kind[at].view(np.uint64) ^ around, 700), return_index=True)
            at, around = at[one] + lo[x], around[one].view(np.int64)
            out.append((kind[at - lo[x]], np.full(len(at), t), np.maximum(at - AROUND, 0), at + AROUND, around, [None] * len(at)))
            # as the later side
            first, last = _heard_ends(count > 0)
            start = np.arange(len(count)) + lo[x]
            skip = settled(start, start + LENGTH - 1, p[spans], hi[spans])
            for a, b, places, u, v in _rarest(np.maximum(count, 0), skip):
                for i in np.flatnonzero(count[places] > 0):
                    start = u[i] + BITS[(v[i] >> BITS) & 1 == 1]
                    ends = np.unique(np.column_stack([first[start], last[start]]) + lo[x], axis=0)
                    out.append(([kind[places[i]]], [t], [lo[x] + a], [lo[x] + b - 1], [0], [ends.tobytes()]))

    def emit(cols):
        out = []
        begin = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        for x, y in zip(begin, np.r_[begin[1:], len(cols[0])]):
            text(cols[0][x], *(c[x:y] for c in cols[1:]), out)
        flat = [np.concatenate(c) for c in list(zip(*out))[:5]] if out else [np.zeros(0, np.int64)] * 5
        passages = pa.array([w for o in out for w in o[5]], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in flat] + [passages], ["tok", "t", "lo", "hi", "around", "passages"])

    parts = []
    for b in batches:
        cols = [np.asarray(b.column(c)) for c in names]
        if not len(cols[0]):
            continue
        done = int(np.searchsorted(cols[0], cols[0][-1]))
        if parts and (done or parts[0][0][0] != cols[0][0]):
            yield emit([np.concatenate(c) for c in zip(*parts, [c[:done] for c in cols])])
            parts = []
        elif done:
            yield emit([c[:done] for c in cols])
        parts.append([c[done:] for c in cols])
    if parts:
        yield emit([np.concatenate(c) for c in zip(*parts)])


def _uncut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_marks`` with a passage that the text's ``spans`` do not settle."""
    for b in batches:
        spans = b.column("spans")
        ends, flat = np.asarray(spans.offsets), spans.values
        begin, stop = np.asarray(flat.field("start")), np.asarray(flat.field("end"))
        keep = np.ones(b.num_rows, bool)
        for i in np.flatnonzero(np.diff(ends)):
            first, last = np.frombuffer(b.column("passages")[i].as_py(), np.int64).reshape(-1, 2).T
            own = slice(ends[i], ends[i + 1])
            keep[i] = not settled(first, last, begin[own], stop[own]).all()
        yield b.select(["tok", "t", "lo", "hi", "passages"]).filter(pa.array(keep))


def _others(scratch: Scratch, rows: DataFrame, texts: DataFrame, crowded: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` and what else of the ranges ``crowded`` repeats a passage of such a range of an earlier or the same text, that has one
    of its rarest tokens."""
    spans = scratch.table(_merged(found))
    toks = _with_ranges(rows, texts, crowded).mapInArrow(_range_tokens, "tok long, t long, p long, lo long, hi long")
    heard = toks.repartition("tok").sortWithinPartitions("tok", "t", "p").mapInArrow(_heard, "tok long, t long, p long, lo long, hi long, n long")
    zero = F.lit(0).cast("long")
    known = spans.select("t", F.explode("spans").alias("s")).select(
        zero.alias("tok"), "t", F.col("s.start").alias("p"), F.lit(-1).cast("long").alias("lo"), F.col("s.end").alias("hi"), zero.alias("n"))
    both = heard.unionByName(known).repartition("t").sortWithinPartitions("t", "lo", "p")
    marks = scratch.table(both.mapInArrow(_marks, "tok long, t long, lo long, hi long, around long, passages binary"))
    seeds = scratch.table(marks.where("passages is not null").drop("around").distinct())
    there = marks.where("passages is null").select("tok", F.col("t").alias("hub"), F.col("lo").alias("hub_lo"), F.col("hi").alias("hub_hi"), "around")
    there = scratch.table(there.join(seeds.select("tok").distinct(), "tok", "left_semi"))
    scratch.drop(marks)
    # tokens are shared or not by what is heard around them, so of equal surroundings the first place speaks for the later ones
    own = seeds.join(there.withColumn("t", F.col("hub")), ["tok", "t"]).where("hub_lo < hi")
    place = F.struct("hub", "hub_lo", "hub_hi")
    kinds = there.groupBy("tok", "around").agg(F.min(place).alias("h")).select("tok", "h.*")
    kinds = scratch.table(kinds.select("tok", "hub", (F.floor(F.col("hub_lo") / HUB_STEP) * HUB_STEP).alias("hub_lo"),
                                       (F.ceil((F.col("hub_hi") + 1) / HUB_STEP) * HUB_STEP).alias("hub_hi")).distinct())
    first = kinds.groupBy("tok").agg(F.min(place).alias("h")).select("tok", "h.*")
    cols = ["t", "lo", "hi", "hub", "hub_lo", "hub_hi"]
    pairs = scratch.table(seeds.join(first, "tok").where("hub < t").select(cols).unionByName(own.select(cols)).distinct())
    found = scratch.table(found.unionByName(_verified(scratch, rows, texts, pairs)))
    # what that leaves uncut meets a few others, as a family of near copies mostly has one without a change just there; then every other one
    some = kinds.groupBy("tok", F.pmod(F.xxhash64("hub"), F.lit(PLACES))).agg(F.min(place).alias("h")).select("tok", "h.*")
    for others in (some, kinds):
        seeds = scratch.table(seeds.join(_merged(found), "t", "left").mapInArrow(_uncut, "tok long, t long, lo long, hi long, passages binary"))
        more = scratch.table(seeds.join(others, "tok").where("hub < t").select(cols).distinct().join(pairs, cols, "left_anti"))
        found = scratch.table(found.unionByName(_verified(scratch, rows, texts, more)))
        pairs = pairs.unionByName(more)
    return found


SPANS = "array<struct<start:bigint,end:bigint>>"


def _merged(found: DataFrame) -> DataFrame:
    """(t, spans): the union of each text's passages, in order, as (start, end) word ranges."""
    one = F.array_sort(F.collect_set(F.struct("start", "end")))
    got = found.groupBy("t").agg(one.alias("s"))

    def join(acc, x):
        last = F.element_at(acc, -1)
        touch = (F.size(acc) > 0) & (x["start"] <= F.when(F.size(acc) > 0, last["end"]).otherwise(F.lit(-1)))
        widened = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                           F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(touch, widened).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    return got.select("t", F.aggregate("s", F.array().cast(SPANS), join).alias("spans"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans, source_ids) per row of ``docs``: ``row`` is the whole row as a struct, ``spans`` the word ranges that repeat a passage of an
    earlier text, in order and apart (empty if none), ``source_ids`` the ids of those texts."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "passages")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("d"))
    texts = _texts(scratch, rows)
    found = scratch.table(_found(scratch, rows, texts))
    names = texts.select(F.col("t").alias("hub"), F.col("id").alias("source_id"))
    sources = found.select("t", "hub").distinct().join(names, "hub").groupBy("t").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    spans = _merged(found).join(sources, "t", "left")
    spans = texts.join(spans, "t", "left").where("spans is not null or n_rows > 1").select("d", F.col("id").alias("first"), "spans", "source_ids")
    spans = scratch.table(spans)  # the joined table grows with the corpus: a sort-merge join at any size
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                        F.xxhash64(text).alias("d"), text.alias("words"))
    got = whole.join(spans.hint("merge"), "d", "left")
    copy = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    n = F.when(copy, F.regexp_count("words", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
    none, nobody = F.array().cast(SPANS), F.array().cast("array<bigint>")
    return got.select("row", F.when(n >= WORDS, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
                      F.when(n >= WORDS, F.array("first")).otherwise(F.coalesce("source_ids", nobody)).alias("source_ids"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space after each."""
    raw = (text or "").encode()
    w = T.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, at = [], 0
    for s, e in spans:
        begin = int(w.start[s])
        stop = int(w.start[e]) if e < len(w.start) else len(raw)
        out.append(raw[at:begin])
        at = stop
    return (b"".join(out) + raw[at:]).decode()
