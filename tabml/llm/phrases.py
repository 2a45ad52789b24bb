"""Phrase collocations per language: multikey three-way quicksort of suffix pointers, one global depth at a time.

A suffix pointer is a place in the words of a piece of text; its keys are the digests of the words from there on.

1. Each task sorts its pointers by three-way partitions on the first ``d`` words (depth d); the sizes of equal partitions are its counts.
2. Equal partitions go to the part that their leading words name: the first d - 1 words, or all d where those stand in more than
   ``HEAVY`` places, so that no part holds the suffixes of one frequent word or pair. A part sorts the tasks' partitions alike, adds their
   sizes and abandons every partition with fewer than ``least`` members.
3. Depth d + 1 takes only pointers whose first d and next d words may have survived (a bitmap of the survivors' digests, of bounded
   size; a stranger that passes it is counted and abandoned like any other).

Word digests carry their language. That no two words share one is checked on the words themselves when depth 1 is counted; if two do, all is
done again with the next seed, so counts are exact.

Scores and limits: see ``collocations``. Nulls: a null text is empty, a null language ``und``. Repeated rows count each. An empty table, or
one without candidates, gives no rows. Texts of any length are read in pieces. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabml.llm import bitmap
from tabml.llm import textnum as T
from tabml.llm.store import Scratch

#: Fixed values of the text form: bytes that end a piece and bytes between the words of one.
BREAKS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
LEAST, WORDS, TOP = 10, 3, 2000
#: A longer phrase that stands in this many percent of a phrase's places makes that one go.
INSIDE_PERCENT = 50
MILLION = 1_000_000
#: Text bytes a task sorts at a time, text bytes a part stands for, fewest parts, and places from which a prefix is routed one word deeper.
FLUSH_BYTES, PART_BYTES, FEWEST_PARTS, HEAVY = 1 << 23, 1 << 22, 48, 200_000
HEAVY_MOST = 1 << 18
#: Partitions up to this size are sorted directly.
SMALL = 1 << 15
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2
_ODD = np.uint64(0xD1342543DE82EF95)


def multikey_partitions(keys: list[np.ndarray], weight: np.ndarray | None = None, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(one pointer, total weight) of each set of pointers with equal keys, in the order of the keys; weight None: one each.

    Three-way partitions by a pivot of the current key; the equal part goes one key deeper. Partitions under ``least`` are abandoned.
    """
    one, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = [(np.arange(len(keys[0])), 0)]
    while stack:
        at, depth = stack.pop()
        if not len(at):
            continue
        size = len(at) if weight is None else int(weight[at].sum())
        if size < least:
            continue
        if depth == len(keys):
            one.append(at[:1])
            total.append(np.array([size]))
        elif len(at) <= SMALL:
            rest = [k[at] for k in keys[depth:]]
            order = np.lexsort(rest[::-1]) if len(rest) > 1 else np.argsort(rest[0], kind="stable")
            new = np.zeros(len(at), dtype=bool)
            new[0] = True
            for k in rest:
                k = k[order]
                new[1:] |= k[1:] != k[:-1]
            first = np.flatnonzero(new)
            sums = np.diff(np.r_[first, len(at)]) if weight is None else np.add.reduceat(weight[at[order]], first)
            keep = sums >= least
            one.append(at[order[first[keep]]])
            total.append(sums[keep])
        else:
            k = keys[depth][at]
            pivot = np.sort(k[:: max(1, len(k) // 255)])[len(k[:: max(1, len(k) // 255)]) // 2]
            less, more = k < pivot, k > pivot
            stack += [(at[more], depth), (at[~(less | more)], depth + 1), (at[less], depth)]
    return np.concatenate(one), np.concatenate(total)


@dataclass
class Pointers:
    """Words of consecutive texts: lower-cased bytes, bounds, digest, language of each; joined: the next word is in the same piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    digest: np.ndarray
    lang: np.ndarray
    joined: np.ndarray


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row bounds, rows) of slices of the rows; a longer row is cut after breaks, where no word and no phrase crosses."""
    for a, b in T.slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= T.SLICE_BYTES:
            yield data[lo:hi], offsets[a: b + 1] - lo, np.arange(a, b)
            continue
        cuts = lo + 1 + np.flatnonzero(_KIND[data[lo:hi]] == 2)
        while lo < hi:
            i = int(np.searchsorted(cuts, lo + T.SLICE_BYTES, side="right")) - 1
            if i < 0 or cuts[i] <= lo:
                i += 1
            to = int(cuts[i]) if i < len(cuts) else hi
            yield data[lo:to], np.array([0, to - lo]), np.array([a])
            lo = to


def pointers(data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, lang_digest: np.ndarray, seed: int) -> Pointers:
    """Words of the rows; lang: language number of each row, lang_digest: of each number."""
    kind = _KIND[data]
    word = kind == 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner], ends[inner - 1] = word[inner], word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    upper = (data - np.uint8(65)) < 26
    low = data + (upper.view(np.uint8) << 5)
    up, down = T.powers(len(low))
    value = T.mix(np.arange(1, 257, dtype=np.uint64), seed)  # another value for every byte and seed
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(value[low] * up, out=sums[1:])
    digest = T.mix((sums[end] - sums[start]) * down[start] + lang_digest[lang[row]], seed + 1)
    breaks = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(kind == 2, out=breaks[1:])
    joined = np.zeros(len(start), dtype=bool)
    joined[:-1] = (row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[end[:-1]])
    return Pointers(low, start, end, digest, lang[row], joined)


def _flushes(batches: Iterator[pa.RecordBatch], seed: int, texts: bool) -> Iterator[tuple[Pointers, list[str]]]:
    """Pointers of about FLUSH_BYTES of text at a time (without their bytes and bounds unless ``texts``), and the languages that their numbers mean."""
    none = np.zeros(0, dtype=np.uint8)
    names: list[str] = []
    held: list[Pointers] = []
    size = 0

    def joined() -> Pointers:
        shift = np.cumsum([0] + [len(p.data) for p in held])
        return Pointers(np.concatenate([p.data for p in held]), np.concatenate([p.start + s for p, s in zip(held, shift)]),
                        np.concatenate([p.end + s for p, s in zip(held, shift)]), *(np.concatenate([getattr(p, f) for p in held]) for f in ("digest", "lang", "joined")))

    for b in batches:
        coded = b.column("lang").dictionary_encode()
        known = {n: i for i, n in enumerate(names)}
        for n in coded.dictionary.to_pylist():
            if n not in known:
                known[n] = len(names)
                names.append(n)
        number = np.array([known[n] for n in coded.dictionary.to_pylist()], dtype=np.int64)[np.asarray(coded.indices)]
        digest = np.array([int.from_bytes(hashlib.md5(f"{seed}\n{n}".encode()).digest()[:8], "little") for n in names], dtype=np.uint64)
        data, off = T.texts(b.column("text"))
        for d, o, rows in pieces(data, off):
            p = pointers(d, o, number[rows], digest, seed)
            held.append(p if texts else Pointers(none, none, none, p.digest, none, p.joined))
            size += len(d)
            if size >= FLUSH_BYTES:
                yield joined(), names
                held.clear()
                size = 0
    if held:
        yield joined(), names


def same_word(p: Pointers, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether words a[i] and b[i] are alike for every i, byte by byte."""
    for i in range(0, len(a), 1 << 18):
        x, y = a[i: i + (1 << 18)], b[i: i + (1 << 18)]
        n = p.end[x] - p.start[x]
        if (n != p.end[y] - p.start[y]).any() or (p.lang[x] != p.lang[y]).any():
            return False
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (p.data[np.repeat(p.start[x], n) + step] != p.data[np.repeat(p.start[y], n) + step]).any():
            return False
    return True


def _strings(p: Pointers, at: np.ndarray) -> pa.Array:
    n = p.end[at] - p.start[at]
    off = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(n, out=off[1:])
    raw = p.data[np.repeat(p.start[at] - off[:-1], n) + np.arange(off[-1])]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(raw.tobytes())).cast(pa.string())


#: Rows of depth 1: a word; a language's total (digest and word null); a mark that two words share a digest (all null, n = -1).
_WORDS = "part int, digest long, lang string, word string, n long"


def _count_words(parts: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, names in _flushes(batches, seed, True):
            order, n = multikey_partitions([p.digest])
            # all members of a set against its one pointer
            nth = np.searchsorted(p.digest[order], p.digest)
            if not same_word(p, np.arange(len(p.digest)), order[nth]):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
                                                  pa.array([-1], pa.int64())], ["part", "digest", "lang", "word", "n"])
                return
            for i in range(0, len(order), 1 << 17):
                at = order[i: i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([
                    pa.array((p.digest[at] % np.uint64(parts)).astype(np.int32)), pa.array(p.digest[at].view(np.int64)),
                    pa.array(names, pa.string()).take(pa.array(p.lang[at])), _strings(p, at), pa.array(n[i: i + (1 << 17)])], ["part", "digest", "lang", "word", "n"])
    return run


def _merge_words(least: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = np.asarray(table.column("n"))
        if (n < 0).any():
            return pa.table({"digest": pa.nulls(1, pa.int64()), "lang": pa.nulls(1, pa.string()), "word": pa.nulls(1, pa.string()), "n": pa.array([-1])})
        digest = np.asarray(table.column("digest")).view(np.uint64)
        one, total = multikey_partitions([digest], n)
        nth = pa.array(one[np.searchsorted(digest[one], digest)])
        alike = pc.and_(pc.equal(table.column("word").take(nth), table.column("word")), pc.equal(table.column("lang").take(nth), table.column("lang")))
        if not pc.all(alike).as_py():
            return pa.table({"digest": pa.nulls(1, pa.int64()), "lang": pa.nulls(1, pa.string()), "word": pa.nulls(1, pa.string()), "n": pa.array([-1])})
        sums = table.group_by("lang").aggregate([("n", "sum")])
        keep = total >= least
        at, many = pa.array(one[keep]), sums.num_rows
        return pa.table({
            "digest": pa.concat_arrays([pa.array(digest[one[keep]].view(np.int64)), pa.nulls(many, pa.int64())]),
            "lang": pa.concat_arrays([*table.column("lang").take(at).chunks, *sums.column("lang").chunks]),
            "word": pa.concat_arrays([*table.column("word").take(at).chunks, pa.nulls(many, pa.string())]),
            "n": pa.concat_arrays([pa.array(total[keep]), *sums.column("n_sum").chunks])})
    return run


def fold(keys: list[np.ndarray]) -> np.ndarray:
    """Digest of a phrase from its words' digests."""
    out = keys[0]
    for k in keys[1:]:
        out = T.mix(out * _ODD + k, 3)
    return out


def pack(keys: list[np.ndarray], n: np.ndarray) -> bytes:
    """A sorted run of phrases: each prefix once with the number of its followers, the followers, and counts of the least width."""
    new = np.zeros(len(n), dtype=bool)
    new[:1] = True
    for k in keys[:-1]:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    width = 1 if n.max(initial=0) < 1 << 8 else 8
    head = np.array([len(n), len(first), width], dtype=np.int64)
    return b"".join([head.tobytes(), *(k[first].tobytes() for k in keys[:-1]), np.diff(np.r_[first, len(n)]).astype(np.uint32).tobytes(),
                     keys[-1].tobytes(), n.astype(f"u{width}").tobytes()])


def unpack(run: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    many, heads, width = (int(x) for x in np.frombuffer(run, np.int64, 3))
    at, keys = 24, []
    for _ in range(depth - 1):
        keys.append(np.frombuffer(run, np.uint64, heads, at))
        at += 8 * heads
    times = np.frombuffer(run, np.uint32, heads, at)
    at += 4 * heads
    last = np.frombuffer(run, np.uint64, many, at)
    n = np.frombuffer(run, f"u{width}", many, at + 8 * many).astype(np.int64)
    return [*(np.repeat(k, times) for k in keys), last], n


def _count_phrases(depth: int, parts: int, seed: int, shared):
    """Packed runs, by part, of the phrases of ``depth`` words whose first and last depth - 1 words may have survived."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive, heavy = shared.value
        for p, _ in _flushes(batches, seed, False):
            m = len(p.digest) - depth + 1
            if m <= 0:
                continue
            ok = bitmap.has(alive, fold([p.digest[j: len(p.digest) - depth + 2 + j] for j in range(depth - 1)]))  # of each phrase one word shorter
            take = ok[:-1] & ok[1:]
            for j in range(depth - 1):
                take &= p.joined[j: m + j]
            at = np.flatnonzero(take)
            keys = [p.digest[at + j] for j in range(depth)]
            one, n = multikey_partitions(keys)
            keys = [k[one] for k in keys]
            lead = fold(keys[:-1])
            deeper = np.isin(lead, heavy)
            part = np.where(deeper, T.mix(fold(keys), 7), T.mix(lead, 7)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            ids, runs = [], []
            for a, b in zip(first, np.r_[first[1:], len(part)]):
                ids.append(int(part[a]))
                runs.append(pack([k[order[a:b]] for k in keys], n[order[a:b]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(runs, pa.binary())], ["part", "run"])
    return run


def _merge_phrases(depth: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), depth) for x in table.column("run")]
        keys = [np.concatenate([g[0][j] for g in got]) for j in range(depth)]
        one, total = multikey_partitions(keys, np.concatenate([g[1] for g in got]), least)
        keys = [k[one] for k in keys]
        return pa.table({f"k{j + 1}": pa.array(k.view(np.int64)) for j, k in enumerate(keys)} | {"digest": pa.array(fold(keys).view(np.int64)), "n": pa.array(total)})
    return run


def frequent(docs: DataFrame, scratch: Scratch, text_col: str, lang_col: str, words: int, least: int, seed: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(totals (lang, n of all words), tables of depth 1 (digest, lang, word, n) and deeper (k1, .., kd, digest, n)), n from ``least`` on."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(FEWEST_PARTS, -(-size // PART_BYTES))
    while True:
        counted = rows.mapInArrow(_count_words(parts, seed), _WORDS).groupBy("part").applyInArrow(_merge_words(least), "digest long, lang string, word string, n long")
        counted = scratch.table(counted)
        if counted.where("n < 0").isEmpty():
            break
        scratch.drop(counted)
        seed += 2
    totals = counted.where("digest is null").groupBy("lang").agg(F.sum("n").alias("n"))
    tables = [counted.where("digest is not null")]
    for depth in range(2, words + 1):
        last = tables[-1]
        facts = last.agg(F.count("*"), F.sum("n")).first()
        alive = bitmap.build(last, F.col("digest"), bitmap.bits_for(facts[0]))
        bound = max(HEAVY, (facts[1] or 0) // HEAVY_MOST)  # so at most HEAVY_MOST digests are heavy
        heavy = np.array([r["digest"] for r in last.where(F.col("n") >= bound).select("digest").collect()], dtype=np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast((alive, heavy))
        runs = rows.mapInArrow(_count_phrases(depth, parts, seed, shared), "part int, run binary")
        kind = ", ".join(f"k{j + 1} long" for j in range(depth)) + ", digest long, n long"
        tables.append(scratch.table(runs.groupBy("part").applyInArrow(_merge_phrases(depth, least), kind)))
    return totals, tables


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``words`` words that stand in ``least`` places of a language.

    The score is the lowest over the cuts of the phrase in two, floor(10**6 a a / (l r)), in decimals of 38 digits; of equal cuts the one with
    the shortest first part. A phrase inside a longer candidate with half of its places is left out. ``top`` is the length of the report for each language.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    totals, tables = frequent(docs, scratch, text_col, lang_col, words, least)
    keys = [[f"k{j + 1}" for j in range(d)] for d in range(words + 1)]
    whole: list[DataFrame] = [None, tables[0].select(F.col("digest").alias("k1"), "lang", F.col("word").alias("phrase"), "n")]

    def part(d: int, first: int, name: str) -> DataFrame:
        """Counts of phrases of d words, keyed as words ``first`` on of a longer one."""
        return whole[d].select(*[F.col(k).alias(f"k{first + j}") for j, k in enumerate(keys[d])], F.col("n").alias(name))

    for d in range(2, words + 1):
        head = whole[d - 1].select(*keys[d - 1], "lang", F.col("phrase").alias("head"), F.col("n").alias(f"l{d - 1}"))
        tail = whole[1].select(F.col("k1").alias(f"k{d}"), F.col("phrase").alias("tail"), F.col("n").alias(f"r{d - 1}"))
        got = tables[d - 1].drop("digest").join(head, keys[d - 1]).join(tail, f"k{d}")
        for k in range(1, d - 1):
            got = got.join(part(k, 1, f"l{k}"), keys[k]).join(part(d - k, k + 1, f"r{k}"), keys[d][k:])
        exact = lambda c: F.col(c).cast("decimal(38,0)")
        cuts = [F.struct(F.expr(f"cast({MILLION} as decimal(38,0)) * cast(n as decimal(38,0)) * cast(n as decimal(38,0)) div "
                                f"(cast(l{k} as decimal(38,0)) * cast(r{k} as decimal(38,0)))").alias("score"), F.lit(k).alias("k"),
                         F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, d)]
        got = got.select(*keys[d], "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "n", F.array_min(F.array(*cuts)).alias("cut"))
        whole.append(scratch.table(got))
    out = None
    for d in range(2, words + 1):
        mine = whole[d]
        inside = [whole[e].select(*[F.col(f"k{first + j}").alias(k) for j, k in enumerate(keys[d])], F.col("n").alias("longer"))
                  for e in range(d + 1, words + 1) for first in range(1, e - d + 2)]
        if inside:
            longer = inside[0]
            for x in inside[1:]:
                longer = longer.unionByName(x)
            mine = mine.join(longer.groupBy(*keys[d]).agg(F.max("longer").alias("longer")), keys[d], "left")
            mine = mine.where(F.col("longer").isNull() | (F.lit(100) * exact("longer") < F.lit(INSIDE_PERCENT) * exact("n")))
        mine = mine.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
        out = mine if out is None else out.unionByName(mine)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
