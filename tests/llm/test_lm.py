"""Language-model scores: the base against brute force, the model against a literal bit-by-bit coder and as a distribution."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabml.llm import lm

SCHEMA = "doc_id long, text string, lang string, bits double, row long, words int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.0, 1, 2, "x") for i, t in rows], SCHEMA)


def learn(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0


def tokens(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, prose(rng, rng.randrange(0, 300))) for i in range(150)]
    out += [(None, "The no id"), (200, None), (201, ""), (202, " \n"), (203, "ONE one"), (7, out[7][1]), (7, out[7][1]), (204, prose(rng, 200) + "\x00日本" * 9)]
    held = next(i for i in range(300, 400) if not learn(i))
    out += [(held, "unseen " * 40 + "日本 Q"), (205, "ab\n" * 400_000)]
    return out


@pytest.fixture(scope="module")
def fitted(spark, rows):
    docs = frame(spark, rows).repartition(3)
    out = lm.held_out(F.col("doc_id"))
    model = lm.fit(docs.where(~out))
    return model, lm.score(docs, model, out).collect()


def test_base(rows, fitted):
    c = collections.Counter(t for i, text in rows if learn(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = []
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        want.append((i, not learn(i), len(ts), sum(c[t] > 0 for t in ts), n, round(base, 4), len((text or "").encode())))
    got = [(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.n_bytes) for r in fitted[1]]
    assert sorted(got, key=str) == sorted(want, key=str)


def slow_bits(t, text):
    """The text's cost, one decision after the other."""
    raw = text.encode()
    x = [255] * 8 + list(raw) + [255]
    weights = [[lm.START] * lm.GATES for _ in range(lm.TABLES)]
    corrections, cost, c = [0.0] * lm.CELLS, 0.0, t.codes
    mask = (1 << t.bits) - 1
    ends = [e for e in lm.ends_of_blocks(len(raw) + 1)]
    for a, b in zip(ends, ends[1:]):
        grad, shift, many = collections.Counter(), collections.Counter(), 0
        for p in range(a + 8, b + 8):
            word = 0
            while word < 8 and x[p - 1 - word] not in (9, 10, 11, 12, 13, 32, 255):
                word += 1
            word = max(word, 2)
            before = int.from_bytes(bytes(x[p - 8: p]), "little")
            keys = [before >> 40, before >> 32, before >> (64 - 8 * word)]
            bases = [((k + 1) * int(m) % (1 << 64)) >> 32 for k, m in zip(keys, lm._MULT)]
            rank = int(c.ranks[(int(c.of[x[p - 2] << 8 | x[p - 1]]) << 8) | x[p]])
            for j in range(int(c.length[rank])):
                at = int(c.start[rank]) + j
                kept = [int(t.odds[i][(bases[i] ^ int(c.salt[at])) & mask]) for i in range(lm.TABLES)]
                gate = (kept[1] != 0) + 2 * (kept[2] != 0) + 4 * (j == 0)
                mixed = min(12.0, max(-12.0, sum(weights[i][gate] * kept[i] / lm.STEPS for i in range(lm.TABLES))))
                cell = round(mixed) + 12
                final = min(14.0, max(-14.0, mixed + corrections[cell]))
                bit = int(c.bit[at])
                chance = 1 / (1 + math.exp(-final))
                cost -= math.log2(chance if bit else 1 - chance)
                miss = bit - 1 / (1 + math.exp(-mixed))
                for i in range(lm.TABLES):
                    grad[i, gate] += miss * kept[i] / lm.STEPS
                shift[cell] += bit - chance
                many += 1
        for (i, g), v in grad.items():
            weights[i][g] += lm.RATE / (many + lm.DAMP) * v
        for k, v in shift.items():
            corrections[k] += lm.REFINE / (many + lm.DAMP) * v
    return cost


def test_model_against_one_decision_at_a_time(rows, fitted):
    model, got = fitted
    by = collections.defaultdict(list)
    for r in got:
        by[r.id].append(r)
    for i, text in rows:
        if text is not None and len(text) < 10_000:
            want = slow_bits(model.tables, text)
            assert all(abs(r.score + want * math.log10(2)) < 1e-3 * max(1, want) for r in by[i])
            assert all((r.bits_per_byte is None) == (not text) for r in by[i])
    texts = [t or "" for _, t in rows]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    together = lm.text_bits(model.tables, data, off)
    alone = [lm.text_bits(model.tables, data[a:b], np.array([0, b - a]))[0] for a, b in zip(off, off[1:])]
    assert np.allclose(together, alone, rtol=1e-5)  # the long text by pieces as well


def test_learns_the_language(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(100)]
    shuffled = [(1000 + i, "".join(rng.sample(t, len(t)))) for i, t in texts]
    docs = frame(spark, texts)
    out = lm.held_out(F.col("doc_id"))
    model = lm.fit(docs.where(~out))
    held = {r.id: r.bits_per_byte for r in lm.score(docs, model, out).collect() if r.held_out}
    mixed = {r.id - 1000: r.bits_per_byte for r in lm.score(frame(spark, shuffled), model, out).collect()}
    assert held and all(held[i] < 2.4 and mixed[i] > 1.5 * held[i] for i in held)


def test_every_byte_has_a_chance(fitted):
    """After any bytes the chances of all following bytes add up to 1."""
    t = fitted[0].tables
    for before in ("", "the", "er ré", "日"):
        alone = lm.text_bits(t, np.frombuffer(before.encode(), np.uint8), np.array([0, len(before.encode())]))
        x = np.concatenate([np.full(8, 255, np.uint8), np.frombuffer(before.encode(), np.uint8)])
        total = 0.0
        for byte in range(256):
            m = lm.Mixer(t, 1)
            y = np.r_[x, np.uint8(byte)].astype(np.uint8)
            m.block(y, lm.word_shifts(y), np.array([len(x)]), np.array([0]))
            total += 2.0 ** -m.bits[0]
        assert abs(total - 1) < 1e-4 and alone[0] > 0


def test_no_training_texts(spark):
    docs = frame(spark, [])
    out = lm.held_out(F.col("doc_id"))
    model = lm.fit(docs.where(~out))
    assert lm.score(docs, model, out).collect() == []
    got = lm.score(frame(spark, [(1, "ab c"), (2, None)]), model, out).orderBy("id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)] and got[0].score < got[1].score < 0


def test_words_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 3)
    rows = [(i, "a a a a b b b c c d e" if i % 2 else "b c zz") for i in range(1, 60)]
    docs = frame(spark, rows)
    out = lm.held_out(F.col("doc_id"))
    model = lm.fit(docs.where(~out))
    assert len(model.tables.head) <= 3 and model.words.count() >= 3
    test_base(rows, (model, lm.score(docs, model, out).collect()))
