"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tabml.llm import (decontaminate, html_text, langid, mixing, neardup, passages, quality, suffix_dedup, tokens, url_filter)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, rank int"


def words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]


def make(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if i % 5 == 4 else f"s{i % 4}", 0, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(30)]
    out = list(base)
    for b in base[:8]:
        w = b.split()
        for _ in range(4):
            c = list(w)
            for i in rng.sample(range(120), 5):
                c[i] = f"x{rng.randrange(999)}"
            out.append(" ".join(c))
    passage = prose(rng, 70)
    for k in range(5):
        out.append(prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 40 + k))
    out += [base[9], base[9], None, "", "   \n ", "one", "one", "Ünï two", prose(rng, 6000), "é" * 150 + "ab" * 200]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return make(spark, corpus).cache()


def test_html_text():
    page = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home, page, one</a></ul></nav>'
            '<div class="ad">Buy, buy, now</div><article><h1>Head &amp; line</h1><p><b>First, long   paragraph\n with text.<br><p>Second &eacute;'
            '<div class="comments"><p>Reader says, hi, there</div><p hidden>no</p></article><aside>More</aside><footer>&copy; x</footer></body>')
    assert html_text.main_text(page) == "Head & line\nFirst, long paragraph with text.\nSecond é"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.main_text("plain &lt;text") == "plain <text"
    assert html_text.main_text("<div><div class=main-body><p>A, b, c and a good deal of text here.</p></div><p>B, too, some text of length that is "
                               "long enough to be kept as a sibling of it.</p></div>").count("\n") == 1


def test_html_text_keeps_the_whole_article():
    body = "Long text, with commas, here. " * 12
    text = body.strip()
    wrap = lambda x: f"<html><body><nav><a href=/>Home</a></nav>{x}<footer>end</footer></body></html>"
    assert html_text.main_text(wrap(f'<div class="post has-social"><p>{body}</div>')) == text
    assert html_text.main_text(wrap(f'<div class="social post"><p>{body}</div>')) == text
    assert html_text.main_text(wrap(f"<div><h1>Title</h1><div><p>{body}</div></div>")) == "Title\n" + text
    assert html_text.main_text(wrap(f"<div><div><h1>Title</h1></div><div><div><p>{body}</div></div></div>")) == "Title\n" + text
    assert html_text.main_text(wrap(f"<main><header><h1>Title</h1></header><p>{body}</main>")) == "Title\n" + text
    assert html_text.main_text(wrap(f"<div><section><p>{body}</section><section><p>Short end.</section></div>")) == text + "\nShort end."
    readers = f'<div id="comments"><div><p>{body * 9}</div></div>'
    assert html_text.main_text(wrap(f"<div><p>{body}</div>{readers}")) == text
    assert html_text.main_text(wrap(f'<article><h1>T</h1><p>{body}</article><div class="promo"><p>{body * 9}</div>')) == "T\n" + text
    assert html_text.main_text(wrap(f'<h1><a href="/">Site</a></h1><div><p>{body}</div>')) == text


def test_html_text_of_deep_and_broken_markup_is_linear():
    n = 30000
    start = time.time()
    assert html_text.main_text("<div>" * n + "<p>hello, world text</p>" + "</div>" * n) == "hello, world text"
    for page in ("<div>x" * n, "<p><b>x" * n, "<i>" + "<b>" * n + "</u></i>" * n + "<p>x", "<ul><li>x" * n, "<table><tr><td>x" * n, "<svg/>x" * n):
        assert html_text.main_text(page).count("x") == page.count("x")
    assert time.time() - start < 60


def test_extract_text_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "<p>Hi</p>", "a"), (2, "<p>Hi</p>", "a")], "page_id long, html string, text string")
    got = html_text.extract_text(df).select("page_id", "extracted.*").collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(1, "", 0), (2, "Hi", 2), (2, "Hi", 2)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_token_counts_and_cache(spark, corpus, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, cache = P.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    texts = corpus + ["a <|endoftext|> b"]
    t = Tokenizer.from_file(path)
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts))
    for _ in range(2):
        got = tokens.count_tokens(make(spark, texts), path, cache)
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({x or "" for x in texts})  # each distinct text was encoded once
    assert tokens.count_tokens(make(spark, []), path).count() == 0


def similar_components(sets, percent):
    par = {i: i for i in sets}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                par[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, corpus, k):
    sets = {}
    for i, t in enumerate(corpus):
        w = words(t)
        sets[i] = {tuple(w[j: j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    want = similar_components(sets, 80)
    got = neardup.near_duplicates(docs, k=k).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in got) and len(got) == len(corpus)


def test_near_duplicates_edge_rows(spark):
    d = make(spark, ["a b c", "a b c", None, "z"], ids=[None, 7, 8, 7])
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(d, k=2).collect()) == [
        (-1, -1, True), (7, 7, True), (7, 7, True), (8, 8, True)]
    assert neardup.near_duplicates(make(spark, []), k=2).count() == 0


def test_near_duplicates_of_texts_that_share_an_id(spark):
    rng = random.Random(12)
    a, b = prose(rng, 60), prose(rng, 60)
    d = make(spark, [a, b, a, b + " more", b], ids=[1, 1, 2, 3, 4])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(d, k=2).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False)]
    groups = {(r.doc_id, r.digest): r.group_id for r in neardup.grouped(d, k=2).collect()}
    assert len(groups) == 5 and len(set(groups.values())) == 2


def test_near_duplicates_far_from_every_hub(spark, monkeypatch):
    """Under the keys that A and B share, unrelated classes are hubs: classes of one symbol run each, by set signatures."""
    import numpy as np

    rng = np.random.RandomState(8)
    a = rng.randint(1, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
    b = a.copy()
    b[::5] += 1  # one symbol of every chunk: A and B share one key of each chunk
    sigs = {10: a, 20: b}
    keyed = [(c, s) for c in range(neardup.CHUNKS) for s in range(1, neardup.WIDTH)]
    for n in range(400):  # each holds the shared symbols of one chunk and others of its own
        c = n % neardup.CHUNKS
        x = rng.randint(1, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
        for d, s in keyed:
            if d == c:
                x[d * neardup.WIDTH + s] = a[d * neardup.WIDTH + s]
        sigs[100 + n] = x
    scratch = neardup.Scratch(spark, "far-test")
    sig = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sigs.items()], "id long, sig binary")
    met = sig.mapInArrow(neardup._keys, "id long, key long")
    parts = spark.createDataFrame([], "id long, component long")
    for size in (neardup.SIG_BLOCK, 16):
        monkeypatch.setattr(neardup, "SIG_BLOCK", size)
        got = neardup._far_members(scratch, scratch.table(met), parts, sig).select("a", "b", "dist").collect()
        assert {(min(r.a, r.b), max(r.a, r.b), r.dist) for r in got} == {(10, 20, 10)}
    # A in a part with the hub of a key, B not: they still meet
    parts = spark.createDataFrame([(10, 10), (100, 10)], "id long, component long")
    assert {(r.a, r.b) for r in neardup._far_members(scratch, scratch.table(met), parts, sig).collect()} <= {(10, 20), (20, 10)}
    assert neardup._far_members(scratch, scratch.table(met.where("id > 10")), parts, sig).isEmpty()


def test_near_duplicates_among_background(spark):
    """Texts that share frequent runs independently of each other (J about 0.25), with near pairs among them, against brute force."""
    rng = random.Random(21)
    common = [f"c{i} d{i}" for i in range(60)]
    texts = []
    for i in range(600):
        own = [f"u{i}x{j} v{i}x{j}" for j in range(24)]
        mine = rng.sample(common, 36) + own
        rng.shuffle(mine)
        texts.append(" . ".join(mine))
    for i in range(0, 600, 6):  # near copies: one own piece changed
        texts.append(texts[i].replace(f"u{i}x3 v{i}x3", f"u{i}y3 v{i}y3"))
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[j: j + 2]) for j in range(len(w) - 1)}
    want = similar_components(sets, 80)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(make(spark, texts), k=2).collect()}
    assert got == want and len({want[i] for i in want}) < len(texts)


def test_suffix_dedup(docs, corpus):
    raw = [(t or "").encode() for t in corpus]
    seen = collections.Counter(b[i: i + 200] for b in raw for i in range(len(b) - 199))
    got = {r.id: r for r in suffix_dedup.summary(suffix_dedup.remove_repeats(docs)).collect()}
    assert len(got) == len(raw)
    for i, b in enumerate(raw):
        hit = [False] * len(b)
        for p in range(len(b) - 199):
            if seen[b[p: p + 200]] > 1:
                hit[p: p + 200] = [True] * 200
        kept = bytes(c for c, h in zip(b, hit) if not h)
        spans = sum(h and (j == 0 or not hit[j - 1]) for j, h in enumerate(hit))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (
            len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest())


def test_loser_tree_merge_keeps_prefixes():
    rng = random.Random(3)
    runs, every = [], []
    for _ in range(5):
        e = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))), b"l", 0, b"k" * 16, rng.randrange(99)) for _ in range(80))
        every += e
        runs.append(suffix_dedup.encode_run(e))
    got = list(suffix_dedup.merge_runs(runs))
    assert [g[1] for g in got] == sorted(e[0] for e in every)
    assert all(g[0] == suffix_dedup.common_prefix(p[1], g[1], 0) for p, g in zip(got, got[1:]))
    assert list(suffix_dedup.merge_runs([])) == []


def test_mixing(spark, docs, corpus):
    got = mixing.mix_sources(docs).withColumn("taken", mixing.taken(F.col("parts"))).collect()
    again = mixing.mix_sources(docs.repartition(3)).withColumn("taken", mixing.taken(F.col("parts"))).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = {i: len(words(t)) for i, t in enumerate(corpus)}
    assert all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] for r in got)
    per = collections.defaultdict(int)
    for r in got:
        per[r.source] += r["size"]
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        level = (sum(per.values()) - sum(3 * per[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * per[s]}
        if not more:
            break
        capped |= more
    took = collections.defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(3 * per[r.source] if r.source in capped else level * weight[r.source])
        took[r.source] += r.taken
    targets = {r.source: r.target for r in got}
    assert all(abs(took[s] - targets[s]) <= max(8, 0.01 * targets[s]) for s in order)
    blocks = [(r.source, p.block, p.epoch, p.start + 0, r.doc_id) for r in got for p in r.parts]
    assert len(blocks) == len(set(blocks))  # no block is drawn twice in a pass
    assert mixing.mix_sources(make(spark, [])).count() == 0
    assert [r.target for r in mixing.mix_sources(make(spark, [None, ""])).collect()] == [0.0, 0.0]


def test_hypergeometric_law(spark):
    c = lambda x: F.lit(x).cast("long")
    d = spark.range(4000).select(mixing.hypergeometric(c(30), c(100), c(40), (F.col("id") + 0.5) / 4000).alias("x"))
    mean, var = d.agg(F.avg("x"), F.var_pop("x")).first()
    assert abs(mean - 12) < 0.05 and abs(var - 40 * 0.3 * 0.7 * 60 / 99) < 0.1


def test_quotas_split_whole(spark):
    q = spark.createDataFrame([(f"a{i}", 10 + 7 * i) for i in range(9)], "key string, q long")
    got = mixing.split_quotas(q, 8, 1).collect()
    for r in q.collect():
        assert sum(g.q for g in got if g.key == r.key) == r.q
    shards = collections.Counter()
    for g in got:
        shards[g.shard] += g.q
    assert max(shards.values()) - min(shards.values()) <= 2


def test_decontamination(spark):
    rng = random.Random(9)
    items = [prose(rng, 30) for _ in range(4)] + [None, "too short"]
    bench = spark.createDataFrame([(i, t, "c") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    changed = items[1].split()
    changed[6], changed[15], changed[22] = "aa", "bb", "cc"
    texts = [prose(rng, 300), prose(rng, 90) + " " + items[0].upper().replace(" ", "\n") + " " + prose(rng, 500), " ".join(changed),
             prose(rng, 20) + " " + " ".join(items[2].split()[5:25]), items[3][: len(items[3]) // 6], None, "", items[0], items[0]]
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(make(spark, texts), bench).collect()}
    assert got == {1: [0], 2: [1], 3: [2], 7: [0], 8: [0]}
    assert decontaminate.contamination(make(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contamination(make(spark, []), bench).count() == 0


def test_decontamination_judges_texts_not_ids(spark):
    rng = random.Random(13)
    leak = prose(rng, 30)
    bench = spark.createDataFrame([(7, leak)], "item_id long, text string")
    d = make(spark, [prose(rng, 50), "x " + leak, "y " + leak, prose(rng, 50), None], ids=[1, 1, None, None, None]).withColumn("items", F.lit(1))
    got = {r.row.text: (r.contaminated, r["items"]) for r in decontaminate.judged(d, bench).collect()}
    assert len(got) == 5 and all(v == ((True, [7]) if leak in (t or "") else (False, [])) for t, v in got.items())


def test_decontamination_masks_hit_every_accepted_pattern():
    from itertools import combinations

    for n in range(1, decontaminate.MIN_OVERLAP + 1):
        every = [m for m in decontaminate.masks([n] if n < decontaminate.SPAN else []) if len(m) <= n]
        most = n - -(-decontaminate.MIN_PCT * n // 100)
        for changed in (c for k in range(most + 1) for c in combinations(range(n), k)):
            assert any(all(x == "0" or o + j not in changed for j, x in enumerate(m)) for m in every for o in range(n - len(m) + 1)), (n, changed)


def test_decontamination_of_short_items_and_close_changes(spark):
    items = ["a1 a2 a3 a4 a5 a6", "b1 b2", "c1 c2 c3 c4 c5 c6 c7 c8 c9 c10 c11 c12 c13", "d1 d2 d3 d4 d5 d6 d7 d8"]
    bench = spark.createDataFrame([(i, t, "c") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    texts = ["x y a1 a2 zz a4 a5 a6 x", "x a1 a2 zz zz a5 a6", "p b1 b2 q", "b2 b1", "c1 c2 c3 c4 zz zz c7 c8 c9 c10 c11 c12 c13",
             "u zz d2 d3 d4 d5 d6 d7 d8 v", "d1 d2"]
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(make(spark, texts), bench).collect()}
    assert got == {0: [0], 2: [1], 4: [2], 5: [3]}


def test_quality(docs, corpus):
    junk = "\n".join(["same words on every line here"] * 20)
    got = {r.doc_id: r for r in quality.judge_quality(make(docs.sparkSession, corpus + [junk])).select("doc_id", "quality.*").collect()}
    for i, t in enumerate(corpus + [junk]):
        w = WORD.findall(t or "")
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cov = {j + x for j in range(len(w) - 2) if c[tuple(w[j: j + 3])] > 1 for x in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov))
        assert r.base_failed == (len(w) < 50 or 100 * len(cov) > 50 * len(w))
        suffixes = sorted(range(len(w)), key=lambda j: w[j:]) if len(w) < 1000 else []
        best = 0
        for a, b in zip(suffixes, suffixes[1:]):
            n = 0
            while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            best = max(best, n)
        if len(w) < 1000:
            assert r.longest == best
    assert got[0].kept and not got[len(corpus)].kept


def test_quality_limits_reject_texts_that_pass_the_base_rule(spark):
    def own(n, tag):
        return [f"{tag}{j}" for j in range(n)]

    line, passage = own(12, "l"), own(25, "p")
    looped = own(52, "a") + line * 4  # 48 of 100 words under repeats, the longest of 36
    pasted = own(60, "a") + passage + own(50, "b") + passage + own(60, "c")  # 50 of 220, the longest 25: only the longest is over
    lines = [w for k in range(4) for w in own(8, f"x{k}_") + own(10, f"y{k}_") + own(8, f"x{k}_")] + own(60, "z")  # 64 of 164, longest 8
    said_twice = own(15, "s") + own(25, "t") + own(15, "s") + own(30, "u")  # one ordinary sentence twice
    got = {r.doc_id: r for r in quality.judge_quality(make(spark, [" ".join(x) for x in (looped, pasted, lines, said_twice)]))
           .select("doc_id", "quality.*").collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(4)] == [False, False, False, True]
    assert (got[0].covered, got[0].longest) == (0.48, 36)
    assert got[1].covered <= quality.MAX_COVERED and got[1].longest == 25
    assert got[2].covered > quality.MAX_COVERED and got[2].longest == 8


def brute_passages(texts):
    """Exact repeats only: words under a 50-word window that a smaller id holds too."""
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = words(t)
        mine = [tuple(w[j: j + 50]) for j in range(len(w) - 49)]
        out[i] = {j + x for j, m in enumerate(mine) if m in seen for x in range(50)}
        seen |= set(mine)
    return out


def test_passages(spark, docs, corpus):
    got = passages.with_spans(docs).where("size(spans) > 0").collect()
    got = {r.row.doc_id: r.spans for r in got}
    for i, must in brute_passages(corpus).items():
        have = {x for s in got.get(i, []) for x in range(s.start, s.end)}
        assert must <= have, i
    assert {63, 64, 65, 66, 67, 68} <= set(got) <= set(range(30, 62)) | {63, 64, 65, 66, 67, 68}  # unlike texts lose nothing
    near = [prose(random.Random(1), 80)]
    w = near[0].split()
    w[40] = "zz"
    got = passages.with_spans(make(spark, near + [" ".join(w[:40] + w[41:])])).orderBy("row.doc_id").collect()
    assert got[0].spans == [] and [(s.start, s.end) for s in got[1].spans] == [(0, 79)] and got[1].source_ids == [0]
    assert passages.cut_words("a  b c\td e", [(1, 3)]) == "a  d e"
    assert passages.with_spans(make(spark, [])).count() == 0


def test_passages_of_frequent_lines(spark):
    """Passages of six lines out of few frequent ones, each passage copied once: the texts around them hold the same lines in other orders."""
    rng = random.Random(8)
    lines = [prose(rng, 10) for _ in range(40)]
    mixed = lambda n: " ".join(rng.choice(lines) for _ in range(n))
    copied = [mixed(6) for _ in range(60)]
    texts = [f"{prose(rng, 30)} {c} {prose(rng, 30)}" for c in copied] + [f"{prose(rng, 20)} {mixed(4)} {prose(rng, 20)}" for _ in range(400)]
    texts += [f"{prose(rng, 25)} {c} {prose(rng, 15)}" for c in copied]
    got = {r.row.doc_id: r.spans for r in passages.with_spans(make(spark, texts)).collect()}
    lost = [i for i in range(60) if not any(s.start <= 25 and s.end >= 85 for s in got[460 + i])]
    assert not lost
    assert not any(got[i] for i in range(60, 460))


def test_passages_ids_copies_and_clashing_names(spark):
    rng = random.Random(9)
    p, q, short = prose(rng, 60), prose(rng, 70), prose(rng, 30)
    texts = [p + " end", q, "x " + p, q, q, short, short, None, f"{prose(rng, 9)} {p}", "y " + q, p + " end"]
    ids = [1, 1, 2, 3, None, 4, 5, 6, None, 1, 1]
    d = make(spark, texts, ids).withColumn("spans", F.lit("a")).withColumn("d", F.lit(1)).withColumn("first", F.lit(2))
    got = [(r.row.doc_id, r.row.text, [(x.start, x.end) for x in r.spans]) for r in passages.with_spans(d).collect()]
    assert sorted(map(str, (g[:2] for g in got))) == sorted(map(str, zip(ids, texts)))
    assert all(not s for _, t, s in got if t in (short, None))
    for passage, at in ((p, {texts[0]: 0, texts[2]: 1, texts[8]: 9}), (q, {q: 0, texts[9]: 1})):
        kept = set()
        for i, t, s in got:
            if t in at:
                assert s in ([], [(at[t], at[t] + len(passage.split()))])
                kept |= {(i, t)} - ({(i, t)} if s else set())
        assert len(kept) == 1  # one text of one id keeps the passage (rows equal in both are one), all others lose it


def test_compact_windows_are_tree_nodes():
    import numpy as np
    rng = np.random.RandomState(4)
    v, bounds = rng.randint(0, 1 << 62, 700).astype(np.uint64) << np.uint64(1), np.array([0, 300, 320, 700])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(v, bounds))))
    want = set()

    def tree(lo, hi):
        if hi - lo >= passages.LENGTH:
            c = lo + int(np.argmin(v[lo:hi]))
            want.add((c, lo, hi - 1))
            tree(lo, c)
            tree(c + 1, hi)
    for a, b in zip(bounds[:-1], bounds[1:]):
        tree(int(a), int(b))
    assert got == want


def test_language_id(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    assert {r[0] for r in d.where(out).select("doc_id").collect()} == {
        r[0] for r in d.select("doc_id").collect() if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    model = langid.fit(d.where(~out))
    got = langid.predict(d.where(out), model).select("lang", "language").collect()
    assert sum(r.lang == r.language.lang for r in got) >= 0.95 * len(got)
    odd = langid.predict(make(spark, [None, "", "12 34!", "é"]), model).select("doc_id", "language.*").collect()
    assert [r[1] for r in sorted(odd)][:3] == ["und"] * 3 and all(0 <= r[2] <= 1 for r in odd)
    empty = langid.fit(d.limit(0))
    assert langid.predict(make(spark, ["a"]), empty).select("language.lang").first()[0] == "und"


def test_language_laws_sum_to_one():
    import numpy as np
    grams = np.array([0x0A0A0A61, 0x0A0A6162, 0x0A616261, 0x61626162, 0x62616263], dtype=np.int64)
    m = langid.Model({"a": (grams, np.array([3.0, 2, 5, 1, 1]))})
    m.lookups()
    for context in (b"aba", b"bab", b"zzz", b"\n\na"):
        rows = [context + bytes([x]) for x in range(256)]
        data = np.frombuffer(b"".join(rows), np.uint8)
        whole = m.bits(data, np.arange(0, 4 * 256 + 1, 4))[:, 0]
        head = m.bits(np.frombuffer(context, np.uint8), np.array([0, 3]))[0, 0]
        assert np.exp2(head - whole).sum() == pytest.approx(1, abs=1e-3)


def test_url_filter(spark):
    urls = [None, "no scheme", "HTTP://WWW.A.Org", "http://x.example.org/es/1?utm_a=1", "http://example.org/en/1x", "http://b.com/fr/q",
            "http://b.com/de/", "http://e.net/p/?b=2&a=1#z", "https://www.E.net/p?a=1&b=2&utm_x=3", "http://e.net/q", "http://other.net//"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("http://e.net/p?a=1&b=2",), (None,), ("http://e.net/p?a=1&b=2",)], "u string")
    from tabml.llm.queries import URL_RULES
    got = {r.page_id: r for r in url_filter.filter_urls(pages, "url", listed, "u", URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("www.a.org", "", None, "allow"), ("x.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/1x", "example.org/en/1", "block"), ("b.com", "/fr/q", "com/fr/", "allow"), ("b.com", "/de/", "com/de/", "block"),
        ("e.net", "/p/", None, "block"), ("www.e.net", "/p", None, "block"), ("e.net", "/q", None, "allow"), ("other.net", "//", None, "allow")]
    none = url_filter.filter_urls(pages, "url", listed.limit(0), "u", []).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(urls)


def test_passages_whose_hubs_hold_other_texts(spark, monkeypatch):
    """Two texts share a passage; under every joint key a third, earlier one is the hub and holds something else."""
    import numpy as np
    import pyarrow as pa

    def one_key(batches):
        for b in batches:
            t = np.asarray(b.column("t"))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(t), np.int64)), pa.array(t), pa.array(np.full(len(t), 59, np.int64))], ["key", "t", "win"])

    rng = random.Random(21)
    line, p = prose(rng, 12), prose(rng, 64)
    near = p.split()
    near[30] = "zz"
    texts = [f"{prose(rng, 30)} {line} {prose(rng, 30)}", p, " ".join(near), f"{prose(rng, 52)} {line}"]
    shared = [f"{t} {line} {prose(rng, 60)} {line}" for t in texts]
    monkeypatch.setattr(passages, "_joint", one_key)
    got = passages.with_spans(make(spark, shared)).orderBy("row.doc_id").collect()
    assert [len(g.spans) for g in got] == [0, 0, 1, 0]
    assert got[2].source_ids == [1] and got[2].spans[0].start == 0 and got[2].spans[0].end >= 63


def test_rare_seeds_hit_every_near_copy():
    import numpy as np

    rng = np.random.RandomState(3)
    for _ in range(200):
        n = rng.randint(1, 50, passages.LENGTH + 20)
        missing = rng.choice(passages.LENGTH, passages.SPARE, replace=False) + 7
        shared = np.zeros(len(n), bool)
        shared[7: 7 + passages.LENGTH] = True
        shared[missing] = False
        n[missing[: rng.randint(0, passages.SPARE + 1)]] = 0
        stretches, places = passages.rare_seeds(n, np.zeros(len(n), bool))
        assert any(x <= 7 and y >= 7 + passages.LENGTH and shared[at].any() for (x, y), at in zip(stretches, places))
        skip = np.ones(len(n), bool)
        assert passages.rare_seeds(n, skip) == ([], [])


def test_passages_of_many_copies_behind_another_hub_meet_in_proportion(spark, monkeypatch):
    """Copies of one passage under keys whose hub holds something else: each meets few others, and each but the first is found."""
    import numpy as np
    import pyarrow as pa

    def one_key(batches):
        for b in batches:
            t = np.asarray(b.column("t"))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(t), np.int64)), pa.array(t), pa.array(np.full(len(t), 59, np.int64))], ["key", "t", "win"])

    met, verified = [], passages._verified

    def counted(scratch, rows, texts, pairs):
        met.append(pairs.distinct().count())
        return verified(scratch, rows, texts, pairs)

    monkeypatch.setattr(passages, "_joint", one_key)
    monkeypatch.setattr(passages, "_verified", counted)
    rng, sums = random.Random(22), []
    line, p = prose(rng, 12), prose(rng, 64)
    for n in (12, 36):
        met.clear()
        texts = [f"{prose(rng, 70)} {line} {line}"] + [f"{p} {prose(rng, 30)} {line}" for _ in range(n)]
        got = passages.with_spans(make(spark, texts)).orderBy("row.doc_id").collect()
        assert [len(g.spans) for g in got] == [0, 0] + [1] * (n - 1)
        assert all(g.spans[0].start == 0 and g.spans[0].end >= 64 for g in got[2:])
        sums.append(sum(met))
    assert sums[1] <= 4 * sums[0], sums


def test_passages_beside_cut_ones_meet_no_others(spark, monkeypatch):
    """Copies of one passage behind a few own words, and before these a long line that few share: the passages that begin in the own words have nothing
    left to share, so the texts do not meet in pairs for them."""
    met, verified = [], passages._verified

    def counted(scratch, rows, texts, pairs):
        met.append(pairs.distinct().count())
        return verified(scratch, rows, texts, pairs)

    monkeypatch.setattr(passages, "_verified", counted)
    rng, sums = random.Random(23), []
    p = prose(rng, 64)
    for n in (12, 36):
        met.clear()
        lines = [prose(rng, 60) for _ in range(n // 3)]
        texts = [f"{prose(rng, 20)} {lines[i // 3]} {prose(rng, 5)} {p}" for i in range(n)]
        got = passages.with_spans(make(spark, texts)).orderBy("row.doc_id").collect()
        assert not got[0].spans and all((85, 149) == (max(g.spans[-1].start, 85), g.spans[-1].end) for g in got[1:])
        sums.append(sum(met[2:]))   # after the hubs and the first places
    assert sums == [0, 0], sums


def test_settled_passages():
    import numpy as np

    heard = np.zeros(120, bool)
    heard[10:70] = True
    first, last = passages._heard_ends(heard)
    n = passages.LENGTH
    assert (first[5], last[5]) == (10, 4 + n) and (first[20], last[20]) == (20, 19 + n) and (first[60], last[60]) == (60, 69) and first[80] > last[80]
    begin, stop = np.array([8, 200]), np.array([10 + n + passages.RUN, 300])
    got = passages.settled(first, last, begin, stop)
    assert got[5] and got[11] and not got[12] and not passages.settled(first, last, begin[1:], stop[1:])[:70].any()


def test_pairs_of_passages_verify_as_one_by_one():
    import numpy as np

    rng = np.random.RandomState(6)
    for _ in range(60):
        pairs = []
        for _ in range(rng.randint(1, 20)):
            b = rng.randint(0, 1 << 62, rng.randint(0, 200)).astype(np.uint64)
            a = b[rng.randint(0, 40):].copy()
            change = rng.rand(len(a)) < rng.choice([0, 0.02, 0.1])
            a[change] = rng.randint(0, 1 << 62, int(change.sum()))
            pairs.append((np.r_[rng.randint(0, 1 << 62, rng.randint(0, 60)).astype(np.uint64), a, a[: rng.randint(0, 80)]], b))
        flat = [np.concatenate(c) for c in zip(*pairs)]
        ends = [np.r_[0, np.cumsum([len(x) for x in c])] for c in zip(*pairs)]
        got = passages.spans_of_pairs(flat[0], ends[0], flat[1], ends[1])
        assert list(zip(*(x.tolist() for x in got))) == [(i, s, e) for i, (a, b) in enumerate(pairs) for s, e in passages.shared_spans(a, b)]


def test_passages_rows_that_span_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.RandomState(4)
    monkeypatch.setattr(passages, "OFTEN", 6)
    for size in (1, 2, 3, 7, 1000):
        def cut(cols, names):
            return [pa.RecordBatch.from_arrays([pa.array(c[x: x + size]) for c in cols], names) for x in range(0, len(cols[0]), size)]

        rows = sorted([tuple(r) for r in rng.randint(0, 4, (60, 3)).tolist()] + [(9, 1, 1), (9, 1, 1)])
        got = [r for b in passages._shared(cut(np.array(rows).T, ["key", "d", "win"])) for r in zip(*b.to_pydict().values())]
        kinds = sorted(set(rows))
        assert got == [r for r in kinds if sum(k[0] == r[0] for k in kinds) > 1]

        toks = sorted([(int(a), i, i, 0, 9) for i, a in enumerate(rng.randint(0, 12, 40))] + [(20, i, i, 0, 9) for i in range(15)])
        got = [r for b in passages._heard(cut(np.array(toks).T, ["tok", "t", "p", "lo", "hi"])) for r in zip(*b.to_pydict().values())]
        want = []
        for i, r in enumerate(toks):
            n = min(6, sum(x[0] == r[0] for x in toks))
            want += [(*r, -n if not i or toks[i - 1][0] != r[0] else n)] * (n > 1)
        assert got == want
