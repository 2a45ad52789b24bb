"""Phrase collocations against brute force over word lists."""

import collections
import random
import re

import numpy as np
import pytest

from tabml.llm import bitmap, phrases

SCHEMA = "doc_id long, text string, lang string, n long, k1 string, score int, phrase string"


def brute(rows, words, least, top):
    """rows: (text, lang). The contract, read literally."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, words + 1):
                for i in range(len(w) - d + 1):
                    f[lang][tuple(w[i: i + d])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0, "k", 1, "p") for i, (t, lang) in enumerate(rows)], SCHEMA)


def run(spark, rows, **kw):
    return sorted(tuple(r) for r in phrases.collocations(frame(spark, rows).repartition(3), **kw).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"W{i}" for i in range(40)] + ["Éa", "éa", "ÉA", "a.b", "x y", "日本"]
    rows = []
    for k in range(120):
        lang = ["en", "de", None, "und", ""][k % 5]
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            w[5:5] = ["Hot", "pair", rng.choice(vocabulary)]
        if k % 4 == 0:
            w += ["new", "york", "city", "hall"]
        sep = [" ", "  ", "\t", " , ", "\n", "\x0b", "!", " \r\n"]
        rows.append(("".join(x + rng.choice(sep[:3] if rng.random() < 0.9 else sep) for x in w), lang))
    rows += [rows[7], rows[7], (None, "en"), ("", None), (" \n,.", "en"), ("one", "xx")]
    rows.append(("long tail " * 20_000 + "z" * 70_000 + ".end of it", "de"))
    return rows


@pytest.mark.parametrize("words,least,top", [(3, 3, 2000), (2, 2, 7), (4, 3, 2000), (3, 10, 5)])
def test_against_brute_force(spark, corpus, words, least, top):
    assert run(spark, corpus, words=words, least=least, top=top) == brute(corpus, words, least, top)


def test_nothing_to_report(spark):
    assert run(spark, []) == run(spark, [(None, None), ("", "en")]) == run(spark, [("a b c", "en")]) == []
    assert phrases.collocations(frame(spark, [])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_exact_beyond_64_bits(spark):
    """10**6 a a passes 64 bits from a = 3,100,000 on."""
    rows = [("a b " * 1_000_000, "en")] * 4 + [("a c, b d", "en")] * 3
    assert run(spark, rows, words=2) == brute(rows, 2, 10, 2000)


def test_multikey_partitions():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 50, 200_000).astype(np.uint64) ** np.uint64(9), rng.integers(0, 30, 200_000).astype(np.uint64)]
    keys[0][:90_000] = 3  # one key holds almost half
    weight = rng.integers(1, 4, 200_000)
    want = collections.Counter()
    for a, b, w in zip(*keys, weight):
        want[int(a), int(b)] += int(w)
    for least in (1, 120, 10**9):
        one, total = phrases.multikey_partitions(keys, weight, least)
        got = [(int(keys[0][i]), int(keys[1][i]), int(t)) for i, t in zip(one, total)]
        assert got == sorted((*k, v) for k, v in want.items() if v >= least)
    run = [k[phrases.multikey_partitions(keys)[0]] for k in keys]
    n = np.arange(len(run[0])) * 7
    back, m = phrases.unpack(phrases.pack(run, n), 2)
    assert all((x == y).all() for x, y in zip(run, back)) and (m == n).all()


def test_words_with_one_digest_are_seen():
    data = np.frombuffer(b"ab cd ab", np.uint8)
    p = phrases.pointers(data, np.array([0, 8]), np.array([0]), np.array([5], dtype=np.uint64), 0)
    assert p.digest[0] == p.digest[2] != p.digest[1] and p.joined.tolist() == [True, True, False]
    assert phrases.same_word(p, np.array([0]), np.array([2])) and not phrases.same_word(p, np.array([0, 0]), np.array([2, 1]))
    other = phrases.pointers(data, np.array([0, 8]), np.array([0]), np.array([5], dtype=np.uint64), 2)
    assert (other.digest != p.digest).all()


def test_bitmap(spark):
    rng = np.random.default_rng(6)
    d = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    from pyspark.sql import functions as F
    on = bitmap.build(spark.createDataFrame([(int(x),) for x in d], "d long"), F.col("d"), bitmap.bits_for(len(d)))
    assert bitmap.has(on, d.view(np.uint64)).all()
    assert bitmap.has(on, rng.integers(0, 1 << 62, 3000).view(np.uint64)).mean() < 0.12
