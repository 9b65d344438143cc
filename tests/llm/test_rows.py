"""Each operator over odd rows and an empty table, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontam, graphs, hashing, lm, neardup, packing, pii, quality, rules, spans
from tests import compare

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACED.findall((text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_word_hashes(odd_texts):
    import pyarrow as pa

    seen = {}
    for i, j, data, off in hashing.blocks(pa.array([t for _, t in odd_texts]), most=5000):
        w = hashing.words(data, off)
        for k in range(j - i):
            own = words(odd_texts[i + k][1])
            got = w.hash[w.first[k] : w.first[k + 1]].tolist()
            assert len(own) == len(got)
            for a, h in zip(own, got, strict=True):
                assert seen.setdefault(a, h) == h
    assert len(set(seen.values())) == len(seen)


# ---- 1 --------------------------------------------------------------------------------------------


def brute_base(t):
    t, out = t or "", []
    luhn = lambda d: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(out))


PRIVATE = [
    "a@b.c_d@e.f x@y.z@q.com", "1.2.3.4.5 300.1.1.1 0255.1.1.1 1.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111111x 4111111111111112",
    "+1 (555) 123-4567. +1234567 +12 345 678 901 234 567 8", "1" * 3000, "1.1." * 2000, "1 " * 3000, "+1" * 2000, "a@" * 2000, "ééé x@ééé.com é@b.co 😀 a@b.co", None, "",
    "call +49 (0) 30.1234-567 or +1-555-010-0000-", "0000000000000000", "+", "@", "1.1.1.1@b.co",
]


def test_pii_base_spans_and_redaction(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string"), allowMissingColumns=True)
    rows = pii.detect(docs).select("doc_id", "text", pii.joined(F.col("_base")).alias("b"), pii.joined(F.col("_spans")).alias("s")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.b == brute_base(r.text)
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    again = {r.doc_id: r.text for r in clean.collect()}
    spanned = {r.doc_id: r for r in rows}
    for i, t in again.items():
        r = spanned[i]
        assert (t is None) == (r.text is None)
        gone, at, out = [x.split(":") for x in r.s.split(",") if x], 0, ""  # by start, then kind
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in gone):
            if a >= at:
                out += r.text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert t is None or t == out + r.text[at:]


def test_pii_of_a_text_with_many_spans(spark):
    import time

    one = "mail ana@example.org, ssn 123-45-6789 or 10.1.2.3 é "
    docs = spark.createDataFrame([(1, one * 8000), (2, one * 3)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.detect(docs).select("doc_id", pii.joined(F.col("_base")).alias("b"), pii.joined(F.col("_spans")).alias("s")).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - began < 120  # 16,000 spans took many minutes when each was held against all
    assert got[1].b == brute_base(one * 8000) and got[1].s.count(",") == 8000 * 3 - 1
    assert clean[1] == "mail [EMAIL], ssn [NATIONAL_ID] or [IP] é " * 8000 and clean[2] == clean[1][: len(clean[2])]


def test_running_values(spark):
    rows = [[], [3], [1, 2], [5, 1, 4, 1, 9, 2, 6], list(range(33)), [1] * 64]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<int>")
    got = df.select("i", pii.running(F.col("a"), lambda x, y: x + y).alias("s"), pii.running(F.col("a"), F.greatest).alias("m")).orderBy("i").collect()
    for r, own in zip(got, rows, strict=True):
        assert r.s == np.cumsum(own, dtype=int).tolist() and r.m == [max(own[: k + 1]) for k in range(len(own))]


def test_pii_finds_other_kinds_and_leaves_numbers(spark):
    texts = ["my ssn 123-45-6789, call (555) 123-4567", 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "write to jane (at) site (dot) com", "IBAN DE44 5001 0517 5407 3249 31", "version 10.200.300 of 2019-10-12", "order 123456789012, ISBN 9781234567897", "meet at noon dot dot"]
    got = [r.s for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select(pii.joined(F.col("_spans")).alias("s")).collect()]
    assert "national_id:7:18" in got[0] and "national_phone:25:39" in got[0]
    assert got[1].startswith("secret:9:") and got[2].startswith("masked_email") and got[3].startswith("iban")
    assert got[4:] == ["", "", ""]


# ---- 2 --------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark, data):
    got = {r.doc_id: r for r in quality.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in labels if got[r.doc_id].held_out]
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= g.score <= 1 for i, g in got.items())
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.9


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(100, 0), (101, None), (105, 1), (106, 1), (107, 0), (108, 1), (108, 1)], "doc_id long, quality int")
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.id].add(r.score)
    assert all(len(s) == 1 for s in by.values())
    assert quality.quality_scores(none, labels).count() == 0
    bare = quality.quality_scores(odd, labels.filter("quality = 9")).collect()
    assert {r.score for r in bare} == {0.5}


def plain_features(text):
    """FEATURES of one text, in plain Python over its bytes."""
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = max(len(w), 1), max(len(raw), 1)
    count = lambda p: len(re.findall(p, raw))
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    lines = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    letters = count(rb"[A-Za-z]")
    return [
        np.log1p(len(w)), sum(map(len, w)) / n, count(rb"[#*$%&|<>]") / n, sum(a == b for a, b in zip(w, w[1:])) / n, len(set(w)) / n, count(rb"[A-Z]") / max(letters, 1),
        count(rb"\|") / n, count(rb"!") / n, count(rb"[0-9]") / size, sum(x[-1:] in b".?" for x in w) / n, 1 - len(set(lines)) / len(lines) if lines else 0,
        1 - len(set(grams)) / len(grams) if len(w) > 5 else 0, sum(len(x) <= 3 for x in w) / n, np.log1p(max(map(len, w), default=0)), count(rb"[\x80-\xff]") / size,
    ]


def test_quality_features_against_plain_python(odd_texts):
    import pyarrow as pa

    more = [(0, "longword" * 100 + " x " + "y " * 700), (1, "a b c\n\n a  b c \nd"), (2, " ".join(f"w{i}" for i in range(1200)))]
    every = [*odd_texts, *more]
    for i, j, data, off in hashing.blocks(pa.array([t for _, t in every], pa.string())):
        got = quality.features(data, off)
        for k in range(j - i):
            assert np.allclose(got[k], plain_features(every[i + k][1]), atol=1e-9), (every[i + k][0], dict(zip(quality.FEATURES, zip(got[k], plain_features(every[i + k][1]), strict=True), strict=True)))


def test_quality_of_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "no id here"), (7, None)], "doc_id long, text string")
    got = docs.select(quality.held_out().alias("h")).collect()
    assert [r.h for r in got] == [False, zlib.crc32(b"7") % 5 == 0]


def test_gam_learns_an_interaction():
    r = np.random.default_rng(0)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :2] = r.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert np.mean((m.scores(x) > 0.5) == y) > 0.9


# ---- 3 --------------------------------------------------------------------------------------------


def test_lm_counts_and_odd_rows(spark, odd, odd_texts, none):
    cfg = lm.LmConfig(frequent=50)
    rows = lm.scored(odd, cfg).collect()
    assert len(rows) == odd.count()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    every = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    c = collections.Counter()
    for i, t in every:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    text = dict(odd_texts)
    for r in rows:
        own = [*words(text[r.doc_id]), None]
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(c[w] > 0 for w in own), n)
        assert abs(base - r.base_score) < 1e-6 * abs(base) and r.score < 0
    assert lm.scored(none, cfg).count() == 0


def test_lm_probabilities_sum_to_one():
    cfg = lm.LmConfig(buckets=64, alone=48, classes=8, dim=4, stride=4)
    r = np.random.default_rng(1)
    ch = lm.Channels(r.integers(0, 50, 300).astype(float), cfg)
    fo = lm.Follow(r.integers(0, 9, (64, 64)).astype(float), ch.unigram, cfg)
    w = lm.start_weights(cfg)
    w = {k: x + r.standard_normal(x.shape).astype(np.float32) for k, x in w.items()}
    m = lm.Model(ch, fo, w, np.zeros(0, np.uint64), np.zeros(0), 0, 0)
    u, target, _ = lm.chunks(r.integers(0, 300, 10), np.array([10]), ch.bucket, 299, cfg)
    every = np.full((300, 4), -1)
    every[:, 2] = np.arange(300)
    p, _ = lm.Scorer(m, cfg).logs(np.repeat(u[1:2], 300, axis=0), every)
    assert abs((10.0**p).sum() - 1) < 1e-4


def test_lm_gradient_and_windows():
    cfg = lm.LmConfig(buckets=16, alone=12, classes=4, dim=3, stride=4)
    r = np.random.default_rng(2)
    ch = lm.Channels(r.integers(1, 50, 40).astype(float), cfg)
    fo = lm.Follow(r.integers(0, 9, (16, 16)).astype(float), ch.unigram, cfg)
    n = np.array([0, 3, 4, 9])
    flat = r.integers(0, 40, n.sum())
    u, target, text = lm.chunks(flat, n, ch.bucket, 39, cfg)
    for k in range(4):  # every id once, in its order, and then the end
        own = target[text == k].ravel()
        assert own[own >= 0].tolist() == [*flat[n[:k].sum() : n[: k + 1].sum()], 39]
    p = {k: (x + 0.3 * r.standard_normal(x.shape)).astype(np.float64) for k, x in lm.start_weights(cfg).items()}

    def loss(q):
        m = lm.Model(ch, fo, {k: x.astype(np.float32) for k, x in q.items()}, None, None, 0, 0)
        return lm.Scorer(m, cfg).logs(u, target)[0].astype(np.float64).mean() * np.log(10)

    p32 = {k: x.astype(np.float32) for k, x in p.items()}
    g = lm.gradient(p32, ch, fo, u, target, cfg)
    follows = np.array([k > 0 and text[k] == text[k - 1] for k in range(len(u))])
    assert all(np.allclose(x, g[k], atol=1e-6) for k, x in lm.gradient(p32, ch, fo, u, target, cfg, follows).items())
    for k in p:
        d = r.standard_normal(p[k].shape)
        up, down = ({**p, k: p[k] + e * d} for e in (1e-2, -1e-2))
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(float((g[k] * d).sum()), abs=3e-3)


def test_lm_trains_on_every_window(spark):
    """Every window of every training document, its tail and its copies reach a gradient step once a round."""
    import pyarrow as pa

    text = " ".join(f"w{i % 37} stone" for i in range(300))
    rows = [(i, text if i < 5 else f"{text} tail{i}") for i in range(20)]
    docs = spark.createDataFrame([*rows, (50, None)], "doc_id long, text string")
    cfg = lm.LmConfig(stride=4)
    code = lm.subwords(cfg)
    ch = lm.Channels(np.ones(code.n), cfg)
    got = lm.gathered(docs, cfg).filter("kind = 3").select("key", "w").collect()
    assert {g.key for g in got} <= set(range(len(cfg.parts)))
    seen = collections.Counter()
    for g in got:
        u, target, follows = lm.laid_out(*lm.unpacked(bytes(g.w)), ch.bucket, cfg)
        seen.update(a.tobytes() + b.tobytes() for a, b in zip(u, target, strict=True))
        assert not follows[0] and all(np.array_equal(u[k, :4], u[k - 1, 4:]) for k in np.flatnonzero(follows))
    pairs = {r.key: r.n for r in lm.pair_counts(lm.gathered(docs, cfg).filter("kind = 3"), spark.sparkContext.broadcast(ch), cfg).collect()}
    after = collections.Counter()
    want = collections.Counter()
    for i, t in [*rows, (50, None)]:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            data, off = hashing.texts(pa.array([t], pa.string()))
            w = hashing.words(data, off)
            unique, where, back, _ = lm.distinct(w.hash)
            flat, n = code.ids(w, data, unique, where, back)
            u, target, _ = lm.chunks(flat, n, ch.bucket, code.end, cfg)
            want.update(a.tobytes() + b.tobytes() for a, b in zip(u, target, strict=True))
            after.update((u[:, 4:][target >= 0] * np.int64(cfg.buckets) + ch.bucket[target[target >= 0]]).tolist())
    assert seen == want and sum(want.values()) > 15 * 150 and pairs == after


@pytest.mark.parametrize("size", [0.3, 3.0])
def test_lm_graphs_give_what_numpy_gives(size):
    """Empty and short texts, windows that follow and that don't, and logits far beyond the bound of 60 (size 3)."""
    assert graphs.available()
    cfg = lm.LmConfig(buckets=16, alone=12, classes=4, dim=3, stride=4)
    r = np.random.default_rng(5)
    ch = lm.Channels(r.integers(1, 50, 40).astype(float), cfg)
    fo = lm.Follow(r.integers(0, 9, (16, 16)).astype(float), ch.unigram, cfg)
    p = {k: (x + size * r.standard_normal(x.shape)).astype(np.float32) for k, x in lm.start_weights(cfg).items()}
    n = np.array([0, 1, 3, 4, 5, 21, 40])
    u, target, _ = lm.chunks(r.integers(0, 40, n.sum()), n, ch.bucket, 39, cfg)
    climb = lm.Climb(p, ch, fo, cfg)
    assert climb.session is not None
    for some in (slice(None), slice(0, 1), slice(9, 14)):
        want = lm.gradient(p, ch, fo, u[some], target[some], cfg)
        got = climb.gradient(u[some], target[some], np.zeros(len(u[some]), bool))
        assert got.keys() == want.keys() == p.keys()
        assert all(got[k].shape == p[k].shape and np.allclose(got[k], want[k], rtol=1e-4, atol=1e-5 * max(1, np.abs(want[k]).max())) for k in want)
    fast, plain = (lm.Scorer(lm.Model(ch, fo, p, None, None, 0, 0), cfg) for _ in range(2))
    assert fast.session is not None
    plain.session = None
    (a, on), (b, same) = fast.logs(u, target), plain.logs(u, target)
    assert np.array_equal(on, same) and len(on) == (target >= 0).sum() and np.allclose(a, b, rtol=1e-4, atol=1e-4)


def test_lm_steps_take_all_windows_in_any_portions():
    cfg = lm.LmConfig(buckets=16, alone=12, classes=4, dim=3, stride=4, steps_of=8)
    r = np.random.default_rng(3)
    ch = lm.Channels(r.integers(1, 50, 40).astype(float), cfg)
    fo = lm.Follow(r.integers(0, 9, (16, 16)).astype(float), ch.unigram, cfg)
    u, target, _ = lm.chunks(r.integers(0, 40, 170), np.array([100, 70]), ch.bucket, 39, cfg)
    once, parts = (lm.Climb(lm.start_weights(cfg), ch, fo, cfg) for _ in range(2))
    once.add(u, target)
    for a in range(0, len(u), 5):
        parts.add(u[a : a + 5], target[a : a + 5])
    a, b = once.end(), parts.end()
    assert once.seen == parts.seen == len(u) and once.steps == parts.steps == -(-len(u) // 8)
    assert all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


# ---- 4 --------------------------------------------------------------------------------------------


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


@pytest.mark.parametrize("block", [10**7, 60])
def test_contamination(spark, odd, odd_texts, none, block):
    text = dict(odd_texts)
    items = [(1, " ".join(text[105].split()[50:90])), (2, "stone light"), (3, None), (4, ""), (5, "漢字 text 😀 ä"), (6, text[114]), (6, text[114]), (7, "aword that is nowhere")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cfg = decontam.DecontamConfig(block_chars=block)
    win = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            win[tuple(w[s : s + n])].add(i)
    rows = decontam.contamination(odd, bench, cfg).collect()
    assert len(rows) >= len(odd_texts)
    for r in rows:
        w, hit, found = alnum(text[r.doc_id]), set(), set()
        for n in {len(k) for k in win}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in win:
                    hit |= set(range(s, s + n))
                    found |= win[tuple(w[s : s + n])]
        assert (r.n_words, r.n_hit, sorted(r.items)) == (len(w), len(hit), sorted(found))
    assert decontam.contamination(none, bench, cfg).count() == 0
    assert all(r.n_hit == 0 for r in decontam.contamination(odd, bench.limit(0), cfg).collect())
    left = decontam.decontaminate(odd, bench, cfg)
    assert left.columns == odd.columns and 114 not in {r.doc_id for r in left.select("doc_id").collect()}


@pytest.mark.parametrize("block", [10**7, 20])
def test_items_without_an_id(spark, tmp_path, monkeypatch, block):
    """Items whose id is null are one item, as in the SQL."""
    docs = [(1, "see stone light under"), (2, "night river"), (3, "other words"), (4, "bright cold night river stone light")]
    items = [(7, "stone light"), (None, "night river"), (None, "bright cold"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    cfg = decontam.DecontamConfig(block_chars=block)
    monkeypatch.setattr(decontam, "DecontamConfig", lambda: cfg)
    assert compare.differ(decontam.op4_benchmark_decontamination(spark, str(tmp_path)), compare.database(str(tmp_path)), decontam.SQL) == ""
    rows = {r.doc_id: r for r in decontam.contamination(*(spark.read.parquet(str(tmp_path / f"{x}.parquet")) for x in ("documents", "benchmark")), cfg).collect()}
    assert {i: (r.n_hit, r["items"]) for i, r in rows.items()} == {1: (2, [7]), 2: (2, [None]), 3: (0, []), 4: (6, [7, None])}


def test_blocks_of_the_benchmark_judge_every_row(spark):
    """Different texts under one id, or without one, with more than one block of the benchmark."""
    docs = [(1, "see stone light"), (1, "night river here now"), (None, "stone light"), (None, "other words"), (None, "night river")]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["stone light", "night river", "x y z"])], "item_id long, text string")
    rows = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, decontam.DecontamConfig(block_chars=20)).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=key) == sorted([(1, 3, 2, [0]), (1, 4, 2, [1]), (None, 2, 2, [0]), (None, 2, 0, []), (None, 2, 2, [1])], key=key)


def test_suffix_array_orders_suffixes():
    r = random.Random(5)
    seq = np.array([r.randint(0, 3) for _ in range(200)], dtype=np.int32)
    order = decontam.suffix_array(seq, 200)
    assert [tuple(seq[i:]) for i in order] == sorted(tuple(seq[i:]) for i in range(200))


# ---- 5 --------------------------------------------------------------------------------------------


def test_rules(odd, odd_texts, none):
    text = dict(odd_texts)
    rows = rules.apply_rules(odd).select("doc_id", "_m.*", "kept").collect()
    for r in rows:
        t = text[r.doc_id] or ""
        w = SPACED.findall(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {p for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert not (r.kept and len(w) < 10)
    assert len(rows) == odd.count() and rules.apply_rules(none).count() == 0


# ---- 7 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cfg", [packing.PackConfig(), packing.PackConfig(segments=3, pool=5), packing.PackConfig(loss=300), packing.PackConfig(cut_to_fill=False)])
def test_packing(spark, odd_texts, none, cfg):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = [*odd_texts, (5000, "a<|endoftext|>b don't  \n\n x"), (5001, "é" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, cfg).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for i, t in rows:
        own = sorted(by[i], key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own])
        assert ids.tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert [p.start for p in own] == np.cumsum([0, *[len(p.ids) // 4 for p in own[:-1]]]).tolist()
    for held in seq.values():
        held.sort(key=lambda p: p.offset)
        size = [len(p.ids) // 4 for p in held]
        assert [p.offset for p in held] == np.cumsum([0, *size[:-1]]).tolist()
        assert sum(size) <= 1024 and len(held) <= cfg.segments and sum(n - (p.start == 0) for n, p in zip(size, held, strict=True)) <= cfg.loss
    assert packing.pack(none, cfg).count() == 0


# ---- 8 --------------------------------------------------------------------------------------------


def test_packing_of_turns_under_a_limit_on_loss(spark):
    """Prompts bear no loss; both limits bind, and the dot product needs fewer sequences than first fit."""
    r = random.Random(6)
    some = lambda n: " ".join(r.choice(["river", "stone", "light", "a", "of"]) for _ in range(n))
    rows = [(i, [(some(p), False), (some(a), True)]) for i in range(160) for p, a in [r.choice([(200, 8), (20, 120), (60, 60)])]]
    rows += [(900, None), (901, []), (902, [(None, True), ("x", None)]), (None, [("alone", True)])]
    cfg = packing.PackConfig(size=256, segments=8, loss=128, pool=200)
    docs = spark.createDataFrame(rows, "doc_id long, turns array<struct<text: string, loss: boolean>>").coalesce(1)
    pieces = packing.pack(docs, cfg).collect()
    tokens, loss, held = collections.Counter(), collections.Counter(), collections.Counter()
    doc = collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == len(p.loss) and p.offset == tokens[p.sequence_id]
        tokens[p.sequence_id] += len(ids)
        loss[p.sequence_id] += sum(p.loss)
        held[p.sequence_id] += 1
        doc[p.doc_id].append((p.start, ids.tolist(), list(p.loss)))
    assert max(tokens.values()) <= 256 and max(loss.values()) == 128 and max(held.values()) <= 8
    assert sum(loss[s] == 128 and tokens[s] < 256 for s in tokens) > 0 and sum(tokens[s] == 256 and loss[s] < 128 for s in tokens) > 0
    code = packing.encoder(packing.default_tokenizer())
    for i, turns in rows:
        parts = [(code(t or "").tolist(), bool(on)) for t, on in turns or []]
        want = [x for p, _ in parts for x in p] + [0]
        mask = [int(on) for p, on in parts for _ in p] + [int(parts[-1][1]) if parts else 0]
        mask[0] = 0
        at = sorted(doc[i])
        assert [x for _, p, _ in at for x in p] == want and [x for _, _, m in at for x in m] == mask


def test_dot_products_beat_first_fit():
    """Whole examples, long prompts with short answers and the other way round, in random order."""
    cfg, r, used = packing.PackConfig(size=256, segments=8, loss=128, pool=300, cut_to_fill=False), random.Random(2), np.zeros(2, int)
    for _ in range(10):
        some = [(r.randint(60, 200), r.randint(1, 20)) if r.random() < 0.5 else ((n := r.randint(20, 110)), n - r.randint(1, 10)) for _ in range(250)]
        bins: list[list[int]] = []
        for n, on in some:
            for b in bins:
                if b[0] + n <= 256 and b[1] + on <= 128 and b[2] < 8:
                    b[0], b[1], b[2] = b[0] + n, b[1] + on, b[2] + 1
                    break
            else:
                bins.append([n, on, 1])
        packer = packing.Packer(cfg, 0)
        for k, (n, on) in enumerate(some):
            packer.add(k, np.ones(n, np.uint32), np.arange(n) >= n - on)
        packer.finish()
        used += [len({p[4] for p in packer.pieces}), len(bins)]
    assert used[0] < used[1]


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_odd_rows(odd, odd_texts, none):
    want = brute_components(odd_texts)
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows)
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("rounds", [0, 1])
def test_near_duplicates_of_a_family(spark, rounds):
    """Edits of one text at all distances, and chains of them: every link counts, also without star rounds."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 5000)}" for _ in range(90)]
    texts = []
    for i in range(150):
        w = list(r.choice(texts)[1].split() if texts and r.random() < 0.4 else base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9)}"
        texts.append((i, " ".join(w)))
    want = brute_components(texts)
    rows = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), neardup.NearConfig(rounds=rounds)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_near_duplicates_of_rows_that_ids_do_not_tell_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(5, a), (5, b), (3, b + " more"), (None, a + " more"), (None, c), (7, a), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert got == collections.Counter([(5, 46, 5), (5, 46, 3), (3, 47, 3), (None, 47, 5), (None, 46, None), (7, 46, 5), (None, 0, None), (9, 0, 9)])


def test_registers_estimate_similarity():
    r = np.random.default_rng(4)
    every = hashing.mix(r.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = np.sort(every[:2500]), np.sort(every[500:])
    cfg = neardup.NearConfig()
    x, y = neardup.registers(a, np.array([0]), cfg), neardup.registers(b, np.array([0]), cfg)
    e = neardup.chance(2500.0, cfg.mantissa)
    assert 0 < e < 0.01
    assert abs(((x == y).mean() - e) / (1 - e) - 2000 / 3000) < 0.1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50)], "x long, y long")
    got = {r.v: r.c for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[50] == 50


# ---- 10 -------------------------------------------------------------------------------------------


def test_repeated_spans(spark, odd, odd_texts, none):
    text = dict(odd_texts)
    rows = spans.cleaned(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r for r in rows}
    for r in rows:
        t, at, out = text[r.doc_id] or "", 0, ""
        for s in filter(None, r.removed.split(",")):
            a, b = map(int, s.split(":"))
            out += t[at:a]
            at = b
        kept = out + t[at:]
        assert r.text == (kept.strip(" \t\n\v\f\r") if r.n_removed else kept)
    passage = words(text[114])
    first = next(i for i, _ in odd_texts if " ".join(passage) in " ".join(words(text[i])))
    assert " ".join(passage) in " ".join(words(got[first].text))
    for i in (112, 113, 114):
        if i != first:
            left = words(got[i].text)
            assert not any(passage[k : k + 50] == left[j : j + 50] for k in range(len(passage) - 49) for j in range(len(left) - 49))
    assert spans.cleaned(none).count() == 0


def brute_cleaned(docs, min_words=16):
    """Sentences of each text and which of them go, in plain Python; for texts with a sentence end at every eighth word at least."""
    cut = {}
    for i, t in docs:
        sents, now = [], []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
            now.append(m.group().translate(LOWER))
            gap = re.match(r"[\x20\x09-\x0D]*", t[m.end() :]).group()
            if re.search(r"[.!?][\"')\]}]?$", now[-1]) or "\n" in gap:
                sents.append(now)
                now = []
        cut[i] = sents + [now] * bool(now)
    runs = collections.defaultdict(list)
    for i, sents in cut.items():
        n = [len(s) for s in sents]
        for a in range(len(sents)):
            for forward in (True, False):
                x, y = (a, a) if forward else (a + 1, a + 1)
                while (y - x < 2 or sum(n[x:y]) < min_words) and (y < len(sents) if forward else x > 0):
                    x, y = (x, y + 1) if forward else (x - 1, y)
                if y - x >= 2 and sum(n[x:y]) >= min_words:
                    runs[tuple(w for s in sents[x:y] for w in s)].append((i, x, y))
    gone = {i: [False] * len(s) for i, s in cut.items()}
    for places in runs.values():
        first = min((i, x, y - x) for i, x, y in places)
        for i, x, y in places:
            if (i, x, y - x) != first:
                gone[i][x:y] = [True] * (y - x)
    return {i: (len(g), sum(g), [w for s, x in zip(cut[i], g, strict=True) if not x for w in s]) for i, g in gone.items()}


def test_spans_against_brute_force(spark):
    r = random.Random(9)
    sentence = lambda: " ".join(r.choice("abcdefg") for _ in range(r.randint(1, 7))) + r.choice([".", "!", "?", '."', "\n", ".\n\n"])
    stock = [" ".join(sentence() for _ in range(r.randint(1, 6))) for _ in range(12)]
    docs = [(i, " ".join(r.choice(stock) if r.random() < 0.5 else sentence() for _ in range(r.randint(0, 9)))) for i in range(60)]
    docs += [(60, docs[3][1]), (61, docs[3][1].upper()), (62, None), (63, "")]
    want = brute_cleaned(docs)
    assert sum(n for _, n, _ in want.values()) > 100
    for x in spans.cleaned(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect():
        n, removed, kept = want[x.doc_id]
        assert (x.n_sentences, x.n_removed, words(x.text)) == (n, removed, kept), x.doc_id


def test_spans_leave_single_texts_alone(spark):
    r = random.Random(12)
    rows = [(i, " ".join(f"q{r.randint(0, 10**6)}{r.choice(['', '.', ''])}" for _ in range(120))) for i in range(30)]
    out = spans.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in out} == set(rows) and all(r.n_removed == 0 for r in out)


def test_every_sentence_of_a_passage_is_in_a_run():
    import pyarrow as pa

    r = random.Random(2)
    t = " ".join(f"v{r.randint(0, 99)}{r.choice(['', '', '.', '!'])}" for _ in range(300))
    data, off = hashing.texts(pa.array([t]))
    w = hashing.words(data, off)
    cfg = spans.SpanConfig()
    begin, first = spans.sentences(w, data, cfg)
    _, a, b = spans.runs(begin, first, cfg)
    cover = np.zeros(len(begin), dtype=int)
    for x, y in zip(a, b, strict=True):
        assert begin[y] - begin[x] >= cfg.min_words and y - x >= cfg.least
        cover[x:y] += 1
    assert (cover[: len(begin) - 1] > 0).all()


def test_unpunctuated_passages_share_a_run(spark):
    """A passage of 50 words or more, a line of its own in one text and inside a longer line in another."""
    r = random.Random(21)
    some = lambda n: [f"u{r.randint(0, 10**6)}" for _ in range(n)]
    few = [x for x in (f"c{i}" for i in range(40)) if word_hash(x) % 4][:5]  # no cut by a word's own hash
    passages = [some(n) for n in (50, 51, 60) for _ in range(60)] + [[few[(i * i + i // 5) % 5] for i in range(70)]]
    rows = []
    for k, p in enumerate(passages):
        rows += [(2 * k, " ".join(p)), (2 * k + 1, " ".join([*some(30), *p, *some(30)]))]
    got = {x.doc_id: x for x in spans.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, p in enumerate(passages):
        left = got[2 * k + 1].text.split()
        assert got[2 * k + 1].n_removed and not any(left[j : j + 50] == p[i : i + 50] for i in range(len(p) - 49) for j in range(len(left) - 49))
        assert got[2 * k].n_removed == 0 or k == len(passages) - 1  # the last repeats itself


def word_hash(x):
    import pyarrow as pa

    return int(hashing.words(*hashing.texts(pa.array([x]))).hash[0])


def test_digests_are_of_joined_names():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_rows_without_an_id(spark):
    """A null in the id column: every operator gives the row back and none fails."""
    rows = [(None, "some words that stand here without any name of their own at all"), (None, None), (1, "a text " * 50), (2, "a text " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "stand here without any name"), (None, "x")], "item_id long, text string").filter("item_id is not null")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    for out in (
        pii.detect(docs), quality.quality_scores(docs, labels), lm.scored(docs, lm.LmConfig(frequent=5)), decontam.contamination(docs, bench), decontam.contamination(docs, bench, decontam.DecontamConfig(block_chars=9)),
        rules.apply_rules(docs), neardup.near_duplicates(docs), spans.cleaned(docs), pii.redact(docs),
    ):
        assert len(out.collect()) >= 4
    assert {p.doc_id for p in packing.pack(docs).collect()} == {None, 1, 2}
