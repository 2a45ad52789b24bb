"""Exact substring dedup over bytes by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a ``WINDOW``-byte string that covers it also starts elsewhere, in any document. Each window has an anchor, the smallest
hash among its ``GRAM``-byte strings (the first of equals), so equal windows have equal anchors at equal offsets. Only suffixes that
start at an anchor are sorted, each with the bytes its windows have left of the anchor.

1. Anchors' gram hashes are counted; those seen twice go into a bitmap of ``BITS`` bits (8 MB whatever the corpus holds; a
   fuller one only lets more suffixes through).
2. Each task sorts the suffixes at anchors the bitmap has, cuts them into runs by gram hash and front-codes them: the length
   of the prefix shared with the suffix before, and the rest.
3. Runs with equal gram hashes meet in one partition and are merged by a loser tree. A head carries the length of its common
   prefix with the last winner; heads with unequal lengths need no look at their bytes, others are compared from there on.
4. The merged order gives the common prefix of neighbours. A window l bytes left of its anchor occurs again if, among the neighbours that
   share WINDOW - l bytes to the right, another has the same l bytes to the left (64-bit hashes of these).
5. Covered ranges are united for each document; the rest is hashed.

Nulls: a null text is empty; null ids are kept. Documents are told apart by id and text; repeated rows are documents of their own,
so they cover each other. Texts under WINDOW bytes lose nothing. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.llm import textnum as T
from tabml.llm.columns import add_struct
from tabml.llm.store import Scratch

WINDOW = 200
GRAM = 72
LEFT = WINDOW - GRAM  # the most bytes a window has left of its anchor
BITS = 26
CELLS = 1 << (BITS - 6)
REGION_CELLS = 1 << 13
#: Suffixes a merge partition gets on average, and text bytes a task sorts as one run.
PART_ROWS = 50_000
RUN_BYTES = 1 << 25
_HEAD = struct.Struct("<HHBB16sq")


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, gram hash) of every anchor of the rows' windows, by place in data."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = T.prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    h = T.span_hash(sums, at, at + GRAM)
    bits = np.uint64(int(n).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = T.sliding_min((h & ~low) | at.astype(np.uint64), LEFT + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    s = np.flatnonzero(np.arange(len(best)) + WINDOW <= end[: len(best)])
    if not len(s):
        return anchors(data[:0], offsets[:1])
    p = (best[s] & low).astype(np.int64)
    new = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]
    cut = np.flatnonzero(new)
    return p[cut], s[cut], s[np.r_[cut[1:], len(s)] - 1], h[p[cut]]


def _gram_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = T.texts(b.column("text"))
        for lo, hi in T.slices(off):
            h = anchors(data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])[3]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["gram"])


def _pack_region(table: pa.Table) -> pa.Table:
    cells = np.zeros(REGION_CELLS, dtype=np.int64)
    at = np.asarray(table.column("cell")) % REGION_CELLS
    cells[at] = np.asarray(table.column("bits"))
    return pa.table({"region": pa.array([int(table.column("region")[0].as_py())], pa.int64()), "bytes": pa.array([cells.tobytes()], pa.binary())})


def common_prefix(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, which is known to be h at least."""
    n = min(len(a), len(b))
    if a[h:n] == b[h:n]:
        return n
    step = 16
    while a[h: h + step] == b[h: h + step]:
        h += step
    while step > 1:
        step //= 2
        if a[h: h + step] == b[h: h + step]:
            h += step
    return min(h, n)


def encode_run(entries: list[tuple[bytes, bytes, int, bytes, int]]) -> bytes:
    """Front-coded form of sorted (right, left, shift, key, anchor) entries."""
    out, last = [], b""
    for right, left, shift, key, anchor in entries:
        h = common_prefix(right, last, 0)
        out.append(_HEAD.pack(h, len(right) - h, len(left), shift, key, anchor))
        out.append(right[h:])
        out.append(left)
        last = right
    return b"".join(out)


def decode_run(run: bytes) -> Iterator[tuple[int, bytes, bytes, int, bytes, int]]:
    """(common prefix with the entry before, right, left, shift, key, anchor) of a run's entries."""
    at, right = 0, b""
    while at < len(run):
        h, tail, left, shift, key, anchor = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        right = right[:h] + run[at: at + tail]
        at += tail
        yield h, right, run[at: at + left], shift, key, anchor
        at += left


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, bytes, int]]:
    """Entries of all runs in the order of ``right``, each with its common prefix with the one before."""
    its = [decode_run(r) for r in runs]
    k = 1
    while k < len(its):
        k *= 2
    heads = [next(it, None) for it in its] + [None] * (k - len(its))
    lcp = [0] * k  # of each head with the last winner

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then that with the winner."""
        if heads[i] is None:
            return j, i
        if heads[j] is None:
            return i, j
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        a, b = heads[i][1], heads[j][1]
        h = common_prefix(a, b, lcp[i])
        if a[h: h + 1] <= b[h: h + 1]:
            lcp[j] = h
            return i, j
        lcp[i] = h
        return j, i

    losers = [0] * k
    best = list(range(k))
    size = k
    while size > 1:  # first round: from the leaves up
        size //= 2
        nxt = []
        for x in range(size):
            w, l = play(best[2 * x], best[2 * x + 1])
            losers[size + x] = l
            nxt.append(w)
        best = nxt
    w = best[0]
    while heads[w] is not None:
        _, right, left, shift, key, anchor = heads[w]
        yield lcp[w], right, left, shift, key, anchor
        heads[w] = next(its[w], None) if w < len(its) else None
        if heads[w] is not None:
            lcp[w] = heads[w][0]
        node = (w + k) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2


def covered(merged: list[tuple[int, bytes, bytes, int, bytes, int]]) -> list[tuple[bytes, int, int]]:
    """(key, start, end) byte ranges under repeated windows."""
    n = len(merged)
    lcp = np.array([m[0] for m in merged] + [0])
    near = np.flatnonzero(np.maximum(lcp[:-1], lcp[1:]) >= GRAM)
    if not len(near):
        return []
    kept = [merged[i] for i in near]
    lcp = lcp[near]  # what was left out has a shorter prefix with either neighbour
    lcp[np.r_[True, near[1:] != near[:-1] + 1]] = 0
    left = np.zeros((len(kept), LEFT), dtype=np.uint64)  # byte j + 1 places left of the anchor
    many = np.array([len(m[2]) for m in kept])
    raw = np.frombuffer(b"".join(m[2] for m in kept), dtype=np.uint8)
    begin = np.cumsum(many) - many
    row = np.repeat(np.arange(len(kept)), many)
    left[row, (begin + many)[row] - 1 - np.arange(len(raw))] = raw
    shift = np.array([m[3] for m in kept])
    twice = np.zeros((len(kept), LEFT + 2), dtype=np.int8)
    h = np.zeros(len(kept), dtype=np.uint64)
    for l in range(LEFT + 1):
        if l:
            h = T.mix(h + left[:, l - 1] + np.uint64(1))
        live = np.flatnonzero((shift <= l) & (l <= many))
        if len(live) < 2:
            continue
        group = np.cumsum(lcp < WINDOW - l)[live].astype(np.uint64)
        key = T.mix(h[live] + group * np.uint64(0x9E3779B97F4A7C15), 5)
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        dup = np.zeros(len(k), dtype=bool)
        dup[1:] |= same
        dup[:-1] |= same
        twice[live[order[dup]], l + 1] = 1
    edge = np.diff(np.c_[twice, np.zeros(len(kept), np.int8)], axis=1)
    r0, first = np.nonzero(edge == 1)
    r1, stop = np.nonzero(edge == -1)
    return [(kept[i][4], kept[i][5] - int(b) + 1, kept[i][5] - int(a) + WINDOW) for i, a, b in zip(r0, first, stop)]


def _runs(shared, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        held: dict[int, list] = {}
        size = 0

        def flush():
            out = []
            for part, entries in held.items():
                entries.sort()
                out.append((part, encode_run(entries)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["part", "run"])

        for b in batches:
            keys = b.column("key").to_pylist()
            data, off = T.texts(b.column("text"))
            for lo, hi in T.slices(off):
                base = off[lo]
                d, o = data[base: off[hi]], off[lo: hi + 1] - base
                p, s0, s1, gram = anchors(d, o)
                place = T.mix(gram, 9) & np.uint64((1 << BITS) - 1)
                ok = np.flatnonzero(bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                raw = d.tobytes()
                row = np.searchsorted(o, p[ok], side="right") - 1
                part = (gram[ok] % np.uint64(parts)).astype(np.int64)
                for q, x, y, r, g in zip(p[ok].tolist(), s0[ok].tolist(), s1[ok].tolist(), row.tolist(), part.tolist()):
                    held.setdefault(g, []).append((raw[q: y + WINDOW], raw[x:q], q - y, keys[lo + r], int(q - o[r])))
                size += len(raw)
                if size >= RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()
    return run


def _merge(table: pa.Table) -> pa.Table:
    got = covered(list(merge_runs([x.as_py() for x in table.column("run")])))
    return pa.table({"key": pa.array([g[0] for g in got], pa.binary()), "start": pa.array([g[1] for g in got], pa.int64()),
                     "end": pa.array([g[2] for g in got], pa.int64())})


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join(out) + raw[at:]


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(key, start, end) of rows (key binary, text): byte ranges under repeated windows; they may overlap."""
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "suffixes")
    grams = rows.select("text").mapInArrow(_gram_hashes, "gram long").groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    grams = scratch.table(grams)
    total = grams.agg(F.sum("c")).first()[0] or 0
    parts = max(1, -(-total // PART_ROWS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = T.mix(np.asarray(b.column("gram")).view(np.uint64), 9) & np.uint64((1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["cell", "bits"])

    cells = grams.select("gram").mapInArrow(places, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    cells = cells.withColumn("region", F.floor(F.col("cell") / REGION_CELLS))
    regions = cells.groupBy("region").applyInArrow(_pack_region, "region long, bytes binary").collect()  # at most 128 rows of 64 KB
    bitmap = np.zeros(CELLS, dtype=np.uint64)
    for r in regions:
        bitmap[r["region"] * REGION_CELLS: (r["region"] + 1) * REGION_CELLS] = np.frombuffer(r["bytes"], dtype=np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)
    runs = rows.mapInArrow(_runs(shared, parts), "part long, run binary")
    return runs.groupBy("part").applyInArrow(_merge, "key binary, start long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text, spans (removed byte ranges, in order) and ``left``, a struct of the digest's counts; see ``RESULT``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("\n"), text)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(name)).alias("key"))
    found = repeated_ranges(rows.select("key", "text")).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    found = Scratch(docs.sparkSession, "suffixes").table(found)
    return rows.join(found, "key", "left").select("id", F.struct("text", "ranges").alias("whole"))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def summary(cut_docs: DataFrame) -> DataFrame:
    def run(column: pa.Array):
        n_bytes, n_removed, n_spans, digest = [], [], [], []
        for x in column:
            raw = x["text"].as_py().encode()
            spans = united([(r["start"], r["end"]) for r in x["ranges"].as_py() or []])
            n_bytes.append(len(raw))
            n_removed.append(sum(e - s for s, e in spans))
            n_spans.append(len(spans))
            digest.append(hashlib.sha256(cut(raw, spans)).hexdigest())
        return {"n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": pa.array(digest, pa.string())}

    return add_struct(cut_docs, "whole", "left", RESULT, run).select("id", "left.*")
