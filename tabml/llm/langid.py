"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree of orders 0 to 3 over bytes (three newlines stand before a text). A node with total T
and d distinct followers codes a known follower with count/(T + d) and escapes with d/(T + d) to the order below, from
which the followers of the longer context are excluded, so every order's law sums to one. The statistics are frozen
before scoring; a text's score is its exact code length in bits under each tree, over all of its bytes.

Frozen laws become lookup tables: followers seen by any language after a context of two or three bytes, a code length for each
language, and the escape cost of the rest. A text is scored by array lookups at all positions at once.

Training uses at most ``train_docs`` rows a language, the first in hash order of their ids (a documented bound, so the
tables that go to the executors are bounded too). Label, source and id are not used to predict.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null label, text or id do not train. Empty tables
give no rows; a training set without rows gives ``und`` everywhere. Ties go to the first label in code point order. Repeated rows
are each scored. The result carries the input's columns, whatever their names, and one struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabml.llm import textnum as T
from tabml.llm.columns import add_struct

TRAIN_DOCS = 300
ORDER = 3
_LETTER = re.compile(r"[^\W\d_]")


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ORDER newlines before each row, and the place of each original byte."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + ORDER * (row + 1)
    out = np.full(len(data) + ORDER * (len(offsets) - 1), 10, dtype=np.uint32)
    out[at] = data
    return out, at


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of the 4-byte grams that end at each byte; all shorter contexts follow from them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            data, off = T.texts(b.column("text"))
            for lo, hi in T.slices(off):
                d, at = padded(data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
                gram = (d[at - 3] << 24) | (d[at - 2] << 16) | (d[at - 1] << 8) | d[at]
                own = np.repeat(langs[lo:hi], np.diff(off[lo: hi + 1]))
                for lang in set(langs[lo:hi]):
                    g, n = np.unique(gram[own == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)),
                                                      pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def followers(grams: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and follower as one number, count) at an order."""
    g, inv = np.unique(grams & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
    return g, np.bincount(inv, weights=n).astype(np.float64)


class Model:
    """Lookup tables of all languages; built once from the counts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        k = len(self.langs)
        if not k:
            return
        tables = [[followers(*counts[x], order) for order in range(ORDER + 1)] for x in self.langs]
        self.seen3 = np.unique(np.concatenate([t[2][0] for t in tables]))   # contexts of two bytes and a follower
        self.ctx3 = np.unique(np.concatenate([t[3][0] >> 8 for t in tables]))
        self.seen4 = np.unique(np.concatenate([t[3][0] for t in tables]))
        self.c1 = np.zeros((1 << 16, k))
        self.e2, self.c2 = np.zeros((1 << 16, k)), np.zeros((len(self.seen3), k))
        self.e3, self.c3 = np.zeros((len(self.ctx3), k)), np.zeros((len(self.seen4), k))
        for j, t in enumerate(tables):
            p0 = self.law(np.zeros(1), t[0], np.full((1, 256), 1 / 256), np.zeros(1, np.int64))
            ctx1 = np.arange(256)
            p1 = self.law(ctx1, t[1], np.repeat(p0, 256, axis=0), ctx1)
            self.c1[:, j] = -np.log2(p1.reshape(-1))
            g2, n2 = t[2]
            low = p1.reshape(-1)[g2 & 0xFFFF]
            p2, esc = self.sparse(g2, n2, low)
            u2 = np.unique(g2 >> 8)
            self.e2[u2, j] = esc
            self.c2[:, j] = self.e2[self.seen3 >> 8, j] + self.c1[self.seen3 & 0xFFFF, j]
            self.c2[np.searchsorted(self.seen3, g2), j] = -np.log2(p2)
            g3, n3 = t[3]
            p3, esc = self.sparse(g3, n3, np.exp2(-self.c2[np.searchsorted(self.seen3, g3 & 0xFFFFFF), j]))
            self.e3[np.searchsorted(self.ctx3, np.unique(g3 >> 8)), j] = esc
            s = self.seen4
            self.c3[:, j] = self.e3[np.searchsorted(self.ctx3, s >> 8), j] + self.c2[np.searchsorted(self.seen3, s & 0xFFFFFF), j]
            self.c3[np.searchsorted(s, g3), j] = -np.log2(p3)
        for name in ("c1", "e2", "c2", "e3", "c3"):
            setattr(self, name, getattr(self, name).astype(np.float32))

    @staticmethod
    def law(ctx: np.ndarray, table: tuple[np.ndarray, np.ndarray], low: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Dense laws over 256 followers of contexts 0..len-1, given those of the order below."""
        n = np.zeros((len(ctx), 256))
        g, c = table
        n[(g >> 8) if len(ctx) > 1 else np.zeros(len(g), np.int64), g & 255] = c
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        rest = np.where(n > 0, 0, low)
        left = rest.sum(1, keepdims=True)
        escape = np.where(left > 0, kinds, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(n > 0, n / (total + escape), np.where(kinds > 0, escape / (total + escape) * rest / left, low))
        return p

    @staticmethod
    def sparse(g: np.ndarray, n: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each seen follower, and each context's cost in bits of an escape with exclusion."""
        _, inv = np.unique(g >> 8, return_inverse=True)
        total, kinds = np.bincount(inv, weights=n), np.bincount(inv).astype(float)
        left = np.maximum(1 - np.bincount(inv, weights=low), 1e-12)
        return n / (total + kinds)[inv], -np.log2(kinds / (total + kinds)) + np.log2(left)

    def lookups(self) -> None:
        """Dense indexes, made on the executor."""
        self.at3 = np.full(1 << 24, -1, dtype=np.int32)
        self.at3[self.seen3] = np.arange(len(self.seen3))
        self.at_ctx3 = np.full(1 << 24, -1, dtype=np.int32)
        self.at_ctx3[self.ctx3] = np.arange(len(self.ctx3))
        self.at4 = np.full(len(self.ctx3) * 256, -1, dtype=np.int32)
        self.at4[np.searchsorted(self.ctx3, self.seen4 >> 8) * 256 + (self.seen4 & 255)] = np.arange(len(self.seen4))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language, (rows, languages)."""
        d, at = padded(data, offsets)
        two = (d[at - 1] << 8) | d[at]
        ctx2 = (d[at - 2] << 8) | d[at - 1]
        three = (ctx2 << 8) | d[at]
        i3 = self.at3[three]
        cost = self.c2[i3]
        miss = np.flatnonzero(i3 < 0)
        cost[miss] = self.e2[ctx2[miss]] + self.c1[two[miss]]
        ctx = self.at_ctx3[(d[at - 3] << 16) | ctx2]
        i4 = np.where(ctx >= 0, self.at4[np.maximum(ctx, 0).astype(np.int64) * 256 + d[at]], -1)
        hit = np.flatnonzero(i4 >= 0)
        esc = np.flatnonzero((i4 < 0) & (ctx >= 0))
        cost[hit] = self.c3[i4[hit]]
        cost[esc] += self.e3[ctx[esc]]
        sums = np.zeros((len(cost) + 1, len(self.langs)))
        np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    rows = train.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("id is not null and lang is not null and text is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = (rows.select("id", "lang").withColumn("i", F.row_number().over(order)).where(F.col("i") <= train_docs)
              .select("id", F.col("lang").alias("l")).distinct())
    # at most train_docs rows a language: a bounded broadcast
    sample = rows.join(F.broadcast(picked.withColumnRenamed("id", "pid")), (F.col("id") == F.col("pid")) & (F.col("lang") == F.col("l")), "left_semi")
    got = count_grams(sample).toPandas()
    return Model({k: (v["gram"].to_numpy(np.int64), v["n"].to_numpy(np.float64)) for k, v in got.groupby("lang")})


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language`` (lang, score): the shortest code and its share among all codes' probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array):
        m = shared.value
        if m.langs and not hasattr(m, "at3"):
            m.lookups()
        data, off = T.texts(column)
        lang, score = [], []
        for lo, hi in T.slices(off):
            if not m.langs:
                lang += ["und"] * (hi - lo)
                score += [0.0] * (hi - lo)
                continue
            bits = m.bits(data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for r in range(hi - lo):
                ok = _LETTER.search(bytes(data[off[lo + r]: off[lo + r + 1]]).decode())
                lang.append(m.langs[best[r]] if ok else "und")
                score.append(float(share[r]) if ok else 0.0)
        return {"lang": pa.array(lang, pa.string()), "score": score}

    return add_struct(docs, text_col, "language", "lang string, score double", run)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2
