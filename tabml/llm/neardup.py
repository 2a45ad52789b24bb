"""Near-duplicate texts by a multi-index Hamming join over b-bit min-hash signatures.

A text's set is its distinct runs of ``k`` lower-cased words. Its signature has ``SYMBOLS`` min-hashes cut to 16 bits. Signatures are
split into ``CHUNKS`` chunks; by the pigeonhole principle two signatures that differ in fewer than CHUNKS * 2 symbols agree in
some chunk up to one symbol, so every chunk is keyed once with each single symbol left out (the enumeration of allowed
chunk errors). All pairs under that distance share a key. At a similarity of 0.8 a pair shares none with probability 2e-6.

No pair is emitted within a group. Texts with the same set are one class. Under each key one class is the hub (smallest keyed
hash, so hubs differ from key to key) and the others meet it first; the components of the star edges up to ``LIMIT`` are parts. Two near
classes can both be far from all of their hubs, so a key whose classes lie in several parts is compared further: the classes
outside its largest part against all of its classes, ``SIG_BLOCK`` by ``SIG_BLOCK``, on signatures. A block emits only edges that join
parts (a spanning forest). So any two classes that share a key and are within LIMIT share a family, a component of both kinds of edges.

In a family, each class is first confirmed against its ``NEAREST`` neighbours of the smallest signature distance. Whatever a family still
has in separate components is then compared in blocks: classes outside the family's largest component against all classes of the other
components, ``BLOCK`` by ``BLOCK``, so that no link is lost. Links are confirmed on full sets (64-bit hashes of the runs).

A signature distance above ``LIMIT`` is taken as similarity below 0.8: for 50 symbols at 0.8 the chance of that is under 1e-6.

Nulls: null, empty and wordless texts have an empty set, size 0, no link, and are their own component; a null id is an id of its
own class but is not linked. Fewer words than ``k`` give the whole sequence as the one run. Repeated rows (same id and set) share a component;
different texts under one id are classes of their own (ids are integers below 2**62). An empty table gives no rows. Only the two named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabml.llm import textnum as T
from tabml.llm.graph import components
from tabml.llm.store import Scratch

CHUNKS, WIDTH = 10, 5
SYMBOLS = CHUNKS * WIDTH
LIMIT = 25
NEAREST = 3
BLOCK = 256
IDS_END = 1 << 62
SIG_BLOCK = 2048
_rng = np.random.RandomState(20240607)
_MULT = (_rng.randint(0, 1 << 31, SYMBOLS).astype(np.uint64) << np.uint64(33)) | (_rng.randint(0, 1 << 31, SYMBOLS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = (_rng.randint(0, 1 << 31, SYMBOLS).astype(np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 31, SYMBOLS).astype(np.uint64)


def distinct_runs(w: T.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct run hashes of each row, sorted, row after row."""
    h, row = T.shingles(w.hashes(), w.first, k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(w.offsets)))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, SYMBOLS) 16-bit symbols; rows with an empty set get zeros."""
    rows = len(bounds) - 1
    out = np.zeros((rows, SYMBOLS), dtype=np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at = bounds[:-1][full]
        for j in range(SYMBOLS):
            low = np.minimum.reduceat(h * _MULT[j] + _ADD[j], at)
            out[full, j] = (T.mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _digests(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each row's set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h, s), dtype=np.uint64)]) for s in (11, 12)]
    return [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in T.word_slices(b.column("text")):
                h, bounds = distinct_runs(w, k)
                n = np.diff(bounds)
                digest = _digests(h, bounds)
                sig = signatures(h, bounds)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), b.column("digest").slice(lo, hi - lo), pa.array(n), pa.array(digest[0]), pa.array(digest[1]),
                     pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "digest", "n", "d1", "d2", "sig"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every class under CHUNKS * WIDTH keys: a chunk's symbols with one left out, four 16-bit symbols mixed with the place."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            ids = np.asarray(part.column("id"))
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype=np.uint16).reshape(len(ids), CHUNKS, WIDTH).astype(np.uint64)
            keys = np.empty((len(ids), CHUNKS, WIDTH), dtype=np.uint64)
            for out in range(WIDTH):
                packed = np.zeros((len(ids), CHUNKS), dtype=np.uint64)
                for j in range(WIDTH):
                    if j != out:
                        packed = (packed << np.uint64(16)) | sig[:, :, j]
                for c in range(CHUNKS):
                    keys[:, c, out] = T.mix(packed[:, c], 100 + c * WIDTH + out)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, SYMBOLS)), pa.array(keys.reshape(-1).view(np.int64))], ["id", "key"])


def _sets(k: int):
    """(name, n, d1, d2, runs) of texts, the runs as bytes of sorted 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in T.word_slices(b.column("text")):
                h, bounds = distinct_runs(w, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(np.diff(bounds)), *map(pa.array, _digests(h, bounds)),
                     pa.array([h[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())], ["name", "n", "d1", "d2", "runs"])
    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                  for x, y in zip(b.column("ra"), b.column("rb"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _compare_block(percent: int):
    """Classes of side 0 against those of side 1 of one block pair; at most 2 * BLOCK expected rows."""
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        ids, comp = np.asarray(table.column("id")), np.asarray(table.column("comp"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(len(ids), SYMBOLS)
        runs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("runs").combine_chunks()] if table.num_rows else []
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        for i in left:
            near = right[(comp[right] != comp[i]) & ((sig[right] != sig[i]).sum(1) <= LIMIT)]
            for j in near:
                if similar(runs[i], runs[j], percent):
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, k: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id). Ids are integers."""
    return grouped(docs, k, percent, id_col, text_col).drop("digest", "group_id")


def grouped(docs: DataFrame, k: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with ``digest`` (``text_digest``) and ``group_id``, a name of the component that no other has (null: linked with nothing)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), text_digest(text).alias("digest"))
    sketch = scratch.table(rows.mapInArrow(_sketch(k), "id long, digest long, n long, d1 long, d2 long, sig binary"))
    linked = sketch.where("n > 0 and id is not null")
    # classes: equal sets; sig is a function of the set. A class is called by its smallest id, if no other class is
    named = scratch.table(linked.groupBy("n", "d1", "d2").agg(F.min("id").alias("name"), F.first("sig").alias("sig")))
    again = named.groupBy("name").agg(F.min(F.struct("n", "d1", "d2")).alias("own"), F.count("*").alias("c")).where("c > 1").select("name", "own")
    past = F.lit(IDS_END) + F.xxhash64("n", "d1", "d2").bitwiseAND(F.lit((1 << 61) - 1))
    called = F.when(F.col("own").isNull() | (F.col("own") == F.struct("n", "d1", "d2")), F.col("name")).otherwise(past)
    classes = scratch.table(named.join(scratch.table(again), "name", "left").select("n", "d1", "d2", "name", called.alias("id"), "sig"))
    scratch.drop(named)
    keys = classes.select("id", "sig").mapInArrow(_keys, "id long, key long")
    hubs = keys.groupBy("key").agg(F.min_by("id", F.xxhash64("key", "id")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    hubs = scratch.table(hubs.select("key", "hub", "c"))  # a join of two exchanges: a hot key's classes can be split among tasks
    met = scratch.table(keys.join(hubs, "key"))
    stars = scratch.table(met.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    sig = classes.select("id", "sig")
    pairs = (stars.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
             .join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b"))
    pairs = pairs.mapInArrow(_distances, "a long, b long, dist int")
    near = scratch.table(pairs.where(F.col("dist") <= LIMIT))
    parts = components(scratch, near.select("a", "b"))
    more = _far_members(scratch, met.where("c > 2").select("key", "id"), parts, sig)  # of two classes both have met
    scratch.drop(met)
    if more.isEmpty():
        family = parts
    else:
        near = near.unionByName(more)
        family = components(scratch, parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b")))
    # full sets of the classes in families only
    wanted = family.select("id").join(classes.select("id", "name", "n", "d1", "d2"), "id")
    texts = rows.join(wanted.select(F.col("name").alias("want")).distinct().hint("shuffle_hash"), F.col("id") == F.col("want"), "left_semi")
    sets = texts.mapInArrow(_sets(k), "name long, n long, d1 long, d2 long, runs binary").dropDuplicates(["name", "n", "d1", "d2"])
    sets = scratch.table(sets.join(wanted, ["name", "n", "d1", "d2"]).select("id", "runs"))
    best = Window.partitionBy("a").orderBy("dist", "b")
    first = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= NEAREST).select("a", "b")
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = first.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    links = scratch.table(full.select("a", "b", "ra", "rb").mapInArrow(_confirm(percent), "a long, b long"))
    got = components(scratch, links)
    state = family.withColumnRenamed("component", "family").join(got, "id", "left")
    state = scratch.table(state.select("id", "family", F.coalesce("component", "id").alias("comp")))
    more = _separate_parts(scratch, state, sig, sets, percent)
    final = components(scratch, links.unionByName(more))
    rep = classes.select("n", "d1", "d2", "name", F.col("id").alias("rep")).join(final, F.col("rep") == F.col("id"), "left")
    rep = scratch.table(rep.select("n", "d1", "d2", "name", F.coalesce("component", "rep").alias("group_id")))
    # a component's name is its smallest id, but where only a class called otherwise has that id
    lowest = rep.groupBy("group_id").agg(F.min("name").alias("lowest")).where("lowest <> group_id")
    rep = rep.join(scratch.table(lowest), "group_id", "left").select("n", "d1", "d2", "group_id", F.coalesce("lowest", "group_id").alias("component_id"))
    inside = linked.select("id", "digest", "n", "d1", "d2").join(rep, ["n", "d1", "d2"]).select("id", "n", "component_id", "digest", "group_id")
    alone = sketch.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"), "digest", F.lit(None).cast("long").alias("group_id"))
    return inside.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "digest", "group_id")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(b.num_rows, SYMBOLS) for c in ("sa", "sb"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x != y).sum(1).astype(np.int32))], ["a", "b", "dist"])


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, dist) up to LIMIT that join parts, of the block pairs (key, i, j) in a sorted partition; a block pair may span batches."""
    names = ("key", "i", "j", "side", "id", "part")
    held: list[np.ndarray] = []

    def edges(side, ids, part, sig):
        up: dict[int, int] = {}

        def root(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x
        right = np.flatnonzero(side == 1)
        rsig, rpart = sig[right], part[right]
        for i in np.flatnonzero(side == 0):
            dist = (rsig != sig[i]).sum(1)
            for j in np.flatnonzero((dist <= LIMIT) & (rpart != part[i])):
                x, y = root(int(part[i])), root(int(rpart[j]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    yield int(ids[i]), int(ids[right[j]]), int(dist[j])

    def groups(cols, sig, whole):
        """Edges of all block pairs but the last, or of all; and where the last begins."""
        key, i, j = cols[:3]
        n = len(key)
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if n else np.zeros(0, np.int64)
        ends = np.r_[new[1:], n]
        out = []
        for x, y in zip(new, ends) if whole else zip(new[:-1], ends[:-1]):
            out += edges(cols[3][x:y], cols[4][x:y], cols[5][x:y], sig[x:y])
        return out, (n if whole or not n else int(new[-1]))

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                           pa.array([o[2] for o in out], pa.int32())], ["a", "b", "dist"])

    sig = np.zeros((0, SYMBOLS), np.uint16)
    for b in batches:
        new = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint16).reshape(b.num_rows, SYMBOLS)
        cols = [np.asarray(b.column(c)) for c in names]
        held = [np.concatenate([h, c]) for h, c in zip(held, cols)] if held else cols
        sig = np.concatenate([sig, new])
        out, at = groups(held, sig, False)
        held, sig = [h[at:] for h in held], sig[at:]
        yield batch(out)
    if held:
        yield batch(groups(held, sig, True)[0])


def _far_members(scratch: Scratch, met: DataFrame, parts: DataFrame, sig: DataFrame) -> DataFrame:
    """(a, b, dist): near classes that share a key of ``met`` (key, id) but no part, as far as needed to join their parts."""
    state = met.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    state = scratch.table(state)
    sizes = state.groupBy("key", "part").agg(F.count("*").alias("c"))
    top = sizes.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("largest"), F.sum("c").alias("all"), F.max("c").alias("most"))
    top = scratch.table(top.where("all > most").select(
        "key", "largest", F.ceil((F.col("all") - F.col("most")) / SIG_BLOCK).cast("int").alias("n_out"),
        F.ceil(F.col("all") / SIG_BLOCK).cast("int").alias("n_all")))
    at = state.join(top, "key").join(sig, "id").withColumn("h", F.xxhash64("id"))
    out = at.where("part <> largest").select("key", F.pmod("h", "n_out").cast("int").alias("i"), F.explode(
        F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), F.lit(0).alias("side"), "id", "part", "sig")
    every = at.select("key", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"), F.pmod("h", "n_all").cast("int").alias("j"),
                      F.lit(1).alias("side"), "id", "part", "sig")
    both = out.unionByName(every).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    got = scratch.table(both.mapInArrow(_join_parts, "a long, b long, dist int"))
    scratch.drop(state)
    return got


def _separate_parts(scratch: Scratch, state: DataFrame, sig: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of one family, by block pairs: classes outside the largest component against all of the others."""
    sizes = state.groupBy("family", "comp").agg(F.count("*").alias("c"))
    top = sizes.groupBy("family").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.sum("c").alias("all"), F.max("c").alias("most"))
    top = scratch.table(top.where("all > most").select(
        "family", "largest", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("n_out"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("n_all")))
    at = state.join(top, "family").withColumn("h", F.xxhash64("id"))
    out = at.where("comp <> largest").select("id", "family", "comp", F.lit(0).alias("side"), F.pmod("h", "n_out").cast("int").alias("i"),
                                             F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    every = at.select("id", "family", "comp", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"),
                      F.pmod("h", "n_all").cast("int").alias("j"))
    both = out.unionByName(every).join(sig, "id").join(sets, "id")
    got = both.select("family", "i", "j", "side", "id", "comp", "sig", "runs").groupBy("family", "i", "j").applyInArrow(
        _compare_block(percent), "a long, b long")
    return scratch.table(got)
