"""The corpus pipeline on a small table: each stage acts, clean documents stay, columns stay."""

import random

import pytest

import corpus_pipeline as C


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    text = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    passage, leak, clean = text(60), text(30), [text(150) for _ in range(6)]
    near = clean[0].split()
    near[70] = "other"
    return leak, [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(
        clean + [" ".join(near), clean[1], "short", None, "x y z " * 60, text(80) + " " + passage, text(90) + " " + passage + " end here",
                 text(60) + " " + leak + " " + text(60)])] + [(3, clean[3], "en", "s1", 0), (None, text(99), "en", None, 0)]


def test_stages(spark, rows, tmp_path):
    leak, data = rows
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, kept = spark.createDataFrame(data, schema), []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}").cache()
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        kept.append(sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect()))
    assert kept[0] == [-1, 0, 1, 2, 3, 3, 4, 5, 6, 7, 11, 12, 13]
    assert kept[1] == kept[2] == [-1, 0, 1, 2, 3, 4, 5, 11, 12, 13]
    assert kept[3] == [-1, 0, 1, 2, 3, 4, 5, 11, 12]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(text[11].split()) == 140 and len(text[12].split()) == 92 and text[12].endswith("end here")
    last = C.STAGES[-1][1](spark, docs, f"file://{tmp_path}").collect()
    assert len(last) == 9 and all(r.taken <= 3 * r.size for r in last if r.size is not None)
    assert all(sum(len(p.text.split()) for p in r.pieces) == r.taken for r in last if r.taken is not None)


def test_empty_table(spark, sf, tmp_path):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_mix_draws_from_rows_with_null_ids(spark, sf):
    data = [(i, " ".join(f"a{i}_{j}" for j in range(40)), "en", "s0", 0) for i in range(4)]
    data += [(None, " ".join(f"n{i}_{j}" for j in range(40)), "en", "s0", 0) for i in range(3)] + [(None, "twin " * 9, "en", None, 0)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.mix(spark, docs, sf).collect()
    key = lambda r: (str(r[0]), r[1], str(r[3]))
    assert sorted(map(key, got)) == sorted(map(key, data))
    assert all(r.size == len(r.text.split()) and r.source_size == {"s0": 280, None: 18}[r.source] for r in got)
    assert all(sum(len(p.text.split()) for p in r.pieces) == r.taken for r in got)
    assert all(set(p.text.split()) <= set(r.text.split()) for r in got for p in r.pieces)
    total = {s: sum(r.taken for r in got if r.source == s) for s in ("s0", None)}
    assert all(abs(total[r.source] - r.target) <= 8 for r in got) and all(r.taken for r in got)
    again = C.mix(spark, docs.repartition(3), sf).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
