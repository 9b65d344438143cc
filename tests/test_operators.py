"""Operators that SQL can't check, and edge cases of those it can."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.config import DedupConfig, stamp
from skein.functions import numbers as N
from skein.functions import text as T
from skein.operators import edges as E
from skein.operators import graph as G
from skein.operators import merge as M
from skein.operators import ranking as R
from skein.operators import redaction as X
from skein.operators import states as St
from skein.sources import tables as S
from skein.streaming import events as Z


def test_entry_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_lsh_candidates_hold_the_similar_pairs(spark, data):
    docs = S.table(spark, data, "documents")
    close = {(r.a, r.b) for r in E.near_pairs(docs, DedupConfig(jaccard=0.95)).collect()}
    found = {(r.a, r.b) for r in E.lsh_candidates(docs).collect()}
    assert close <= found


def test_clique_refuses_too_many_edges(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(10)], "doc_id long, text string")
    with pytest.raises(ValueError):
        E.exact_clique(docs, 5)
    assert E.exact_star(docs).count() == 9


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components_against_union_find(spark, pairs):
    got = {r.v: r.c for r in G.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {v: find(v) for v in root if any(v in p and p[0] != p[1] for p in pairs)}


def test_reconcile_is_stable(spark):
    edges = spark.createDataFrame([(1, 2, 0.9, "m"), (2, 3, 0.8, "m")], "a long, b long, score double, method string")
    read = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = {(r.a, r.b): r.action for r in E.reconciled(edges, edges, read.unionByName(spark.createDataFrame([(3,)], "doc_id long"))).collect()}
    assert set(out.values()) == {"unchanged"}
    out = {(r.a, r.b): r.action for r in E.reconciled(edges.filter("a = 9"), edges, read).collect()}
    assert out == {(1, 2): "prune"}  # an edge with an end that wasn't read is left alone


def test_hash_chain_walks_from_the_start(spark, data):
    from skein.plans.registry import QUERIES

    events = {r.event_id: r for r in S.table(spark, data, "events").collect()}
    by = {}
    for r in QUERIES["audit_chain"](spark, data).collect():
        by.setdefault(r.user_id, []).append(r)
    for rows in by.values():
        h = b"\x00"
        for r in sorted(rows, key=lambda r: r.event_id):
            e = events[r.event_id]
            h = hashlib.sha256(h + f"{e.ts:%Y-%m-%d %H:%M:%S}|{e.event_type}|{e.event_id}".encode()).digest()
            assert r.row_hash == h.hex()


@given(st.lists(st.tuples(st.text("ab c", max_size=12), st.integers(0, 3)), max_size=12))
def test_greedy_groups_compare_to_the_seed(statements):
    groups = M.greedy_groups(statements, 0.7)
    assert sorted(itertools.chain(*groups)) == sorted(statements)
    tok = lambda s: frozenset(M._TOKEN.findall(s.lower()))
    for g in groups:
        assert all(M.token_jaccard(tok(g[0][0]), tok(s)) >= 0.7 for s, _ in g)


def test_word_diff_rebuilds_both(spark):
    rows = [(1, "a b c d", "a x c d e"), (2, None, "new words"), (3, "", ""), (4, "same", "same")]
    df = spark.createDataFrame(rows, "k long, before string, after string")
    got = {}
    for r in M.word_diffs(df, ["k"]).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.kind, r.words))
    for k, a, b in rows:
        spans = got.get(k, [])
        assert " ".join(w for kind, w in spans if kind != "insert").split() == (a or "").split()
        assert " ".join(w for kind, w in spans if kind != "delete").split() == (b or "").split()


def test_text_builders(spark):
    one = spark.createDataFrame([("ﬁt “x”​ — y\n\nz",)], "t string")
    assert one.select(T.fold(F.col("t")).alias("f")).first().f == 'fit "x" - y\nz'
    assert T.like_escaped("50%_\\") == "%50\\%\\_\\\\%"
    assert one.select(T.grounded(F.array().cast("array<string>"), F.array(F.lit("a")), 0.5).alias("g")).first().g
    assert abs(T.s_curve(16, 8) - 0.7071) < 1e-3
    assert one.select(N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first().c == 0.0
    assert stamp(DedupConfig()) == stamp(DedupConfig()) != stamp(DedupConfig(jaccard=0.9))


def test_decoded_bytes(spark):
    rows = [("é".encode("utf-16"), "é"), (b"\xef\xbb\xbfok", "ok"), ("é".encode(), "é"), ("é".encode("latin-1"), "é"), (b"a\x00b", "ab"), (None, None)]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None, t) for b, t in rows], "b binary, t string")
    assert all(r.d == r.t for r in df.select("t", S.decoded(F.col("b")).alias("d")).collect())


def test_archive_and_artifacts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.TXT").write_text("x")
    (tmp_path / "in/b.bin").write_text("y" * 100)
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.archive(spark, str(tmp_path / "in"), max_bytes=10).collect()}
    assert rows["a.TXT"].format == "txt" and rows["a.TXT"].sha256 == hashlib.sha256(b"x").hexdigest()
    assert rows["b.bin"].status == "too_large" and rows["b.bin"].content is None
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string")
    S.write_artifact(df, str(tmp_path / "out"), "json", "k")
    back = S.jsonl(spark, str(tmp_path / "out"), "k long, v string")
    assert [r.v for r in back.orderBy("k").collect()] == ["a", "b"]
    (tmp_path / "bad.jsonl").write_text('{"k": 1, "v": "a"}\nnot json\n')
    assert S.jsonl(spark, str(tmp_path / "bad.jsonl"), "k long, v string").select("k", F.col("_corrupt").isNotNull().alias("bad")).collect().count((None, True)) == 1


def test_strided_sample_and_numbering(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in S.strided(df, 4, "k").orderBy("k").collect()] == [0, 25, 50, 75]
    with pytest.raises(ValueError):
        S.strided(df, 0, "k")
    assert all(r.k == r._i for r in S.numbered(df, "k").collect())


def test_numbering_of_wide_rows_over_many_ranges(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        df = spark.range(40_000).select(F.pmod(F.col("id") * 7919, F.lit(40_000)).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        out = S.numbered(df, "k").collect()  # with the wide column, so that its ranges aren't those of the counts
        assert len(out) == 40_000 and all(r.k == r._i for r in out)
    finally:
        spark.conf.set(key, before)


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (None,)], "s double")
    got = {r.bin: r.n for r in R.histogram(df, "s", 10.0, 10).collect()}
    assert len(got) == 10 and got[0] == 1 and got[9] == 1 and sum(got.values()) == 2


def test_descendants(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string")
    got = {(r.ancestor, r.node) for r in G.descendants(tree).collect()}
    assert {("a", "c"), ("a", "a"), ("b", "c")} <= got and ("c", "a") not in got


def test_stream_is_ingested_once(spark, data, tmp_path):
    events = S.table(spark, data, "events")
    events.limit(50).write.parquet(str(tmp_path / "in"))
    for more in (0, 30):
        if more:
            events.limit(more).write.mode("append").parquet(str(tmp_path / "in"))
        Z.ingest_available(Z.arriving(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "out"), str(tmp_path / "at"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 50 + more


def test_windows_of_a_stream_match_the_batch(spark, data, tmp_path):
    events = S.table(spark, data, "events")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = Z.arriving(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = Z.tumbling(stream, "1 hour").writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    n = {(str(r.start), r.event_type): r.n for r in spark.sql("select * from tumbling").collect()}
    assert n == {(str(r.start), r.event_type): r.n for r in Z.tumbling(events, "1 hour").collect()}


def test_neighbours_across_blocks(spark, data):
    rows = S.table(spark, data, "embeddings")
    one = {(r.vec_id, r.rank): (r.other, round(r.score, 9)) for r in R.neighbours_in_bucket(rows, 3).collect()}
    many = {(r.vec_id, r.rank): (r.other, round(r.score, 9)) for r in R.neighbours_in_bucket(rows, 3, block=16).collect()}
    assert one == many and len(one) == 3 * rows.count()


def test_redaction_cuts_every_occurrence_once(spark):
    long = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"x{long}y and {long}."), (2, "short bit, a short bit"), (3, None), (4, "a one two three four five six seven eight nine ten"), (5, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "short bit"), (3, "bit, a"), (4, long + " ten"), (5, ""), (6, None), (7, r"\E+")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_cuts) for r in X.redacted(docs, items).collect()}
    assert got[1] == ("x y and  .", 2) and got[3] == (None, 0) and got[4] == ("a  ", 1) and got[5] == ("clean", 0)
    assert "short" not in got[2][0] and "bit" not in got[2][0]


def test_states_walk_in_order_and_refuse(spark):
    rows = [(1, 3, "go"), (1, 1, "open"), (1, 2, "open"), (2, 1, "go"), (None, 1, "open")]
    out = St.walked(spark.createDataFrame(rows, "k long, i long, e string"), "k", ["i"], "e", {("shut", "open"): "open", ("open", "go"): "shut"}, "shut").collect()
    assert {(r.k, r.i): (r.before, r.after, r.allowed) for r in out} == {(1, 1): ("shut", "open", True), (1, 2): ("open", "open", False), (1, 3): ("open", "shut", True), (2, 1): ("shut", "shut", False), (None, 1): ("shut", "open", True)}


def test_estimates_are_near_the_exact_similarity(spark, data):
    from skein.plans.registry import QUERIES

    rows = QUERIES["m3_estimated_jaccard"](spark, data).collect()
    assert rows and all(abs(r.estimate - r.score) < 0.25 for r in rows)


@pytest.mark.parametrize("name", ["c3_role_edges", "c5_clustering_pass"])
def test_checkpoints_stay_small_beside_the_texts(spark, data, name):
    """A row for each shingle of a text, written, is many times the text."""
    from pathlib import Path

    from skein.plans import registry

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = held()
    registry.QUERIES[name](spark, data).count()
    texts = spark.read.parquet(f"{data}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert held() - before < 2 * texts


def test_block_grams_against_sets():
    texts = ["", "a b c d e", "a b c d e a b c d e", "x", "e a  b,c\nd e f1 g", "b c d e", "é a b\u00a0c d e é", "", "a b c d e"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    n, flat = E.block_grams(np.frombuffer(b"".join(raw), np.uint8), off, 5)
    words = [re.findall("[a-z0-9]+", t) for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    got = [set(x.tolist()) for x in np.split(flat, np.cumsum(n)[:-1])]
    assert n.tolist() == [len(x) for x in want] == [len(x) for x in got]
    assert all(len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_best_of_keeps_ties_in_order():
    s = np.array([[0.5, 0.9, 0.9, 0.9], [-np.inf, 0.1, 0.2, 0.1], [-np.inf, -np.inf, 1.0, -np.inf]])
    row, col = R.best_of(s, 2)
    assert row.tolist() == [0, 0, 1, 1, 2] and col.tolist() == [1, 2, 2, 1, 2]
