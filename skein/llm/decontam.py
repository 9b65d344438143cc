"""Benchmark decontamination with suffix arrays over the training texts.

Every Python task cuts its documents into shards of bounded size. A shard's words become ids of the
benchmark's vocabulary; runs of known words shorter than any window can't match and are left out, the
rest is one sequence with a suffix array (prefix doubling). Every test suffix is found in it by binary
search: the range of suffixes that begin with its window gives all locations, and comparing on from
there gives the longest verbatim match. Matches of any shard are complete, as windows don't cross
documents and documents don't cross shards.

The benchmark is the stated query set: it is sent to the tasks in blocks of bounded size, one pass over
the documents for each block. Null or empty documents have no words; null or empty items no windows;
repeated rows of an item count once, and all items without an id are one, a null among the items of a
document; repeated document rows are judged each. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import cut, numbered, ship, table, unused

#: Bytes of text in a shard (a longer document is a shard of its own).
SHARD_BYTES = 1 << 21


@dataclass(frozen=True)
class DecontamConfig:
    window: int = 13
    share: int = 20  # a document is contaminated if hit words times this reach its words
    block_chars: int = 8_000_000  # of benchmark text sent to a task at once


class Probe:
    """A block of the benchmark: vocabulary, test suffixes by window length, and the items they are of."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        named = {(i if i is None else int(i), t) for i, t in items if t}
        self.names: list[int | None] = [*sorted({i for i, _ in named if i is not None}), None]  # no id comes last
        code = {i: k for k, i in enumerate(self.names)}
        items = sorted((code[i], t) for i, t in named)
        w = hashing.words(*hashing.texts(pa.array([t for _, t in items], pa.large_string())), inside=hashing.ALNUM)
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        ids = (ids + 1).astype(np.int32)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # length, windows, item's place in names, suffix in all
        self.words = np.concatenate([ids, np.zeros(1, np.int32)])
        self.last = np.zeros(len(ids) + 1, dtype=np.int64)  # where the item of each word ends
        by: dict[int, list[tuple[int, int]]] = {}
        for k, (item, _) in enumerate(items):
            a, b = int(w.first[k]), int(w.first[k + 1])
            self.last[a:b] = b
            n = min(window, b - a)
            for s in range(a, b - n + 1) if n else ():
                by.setdefault(n, []).append((s, item))
        for n, found in sorted(by.items()):
            at = np.array([s for s, _ in found], dtype=np.int64)
            self.groups.append((n, ids[at[:, None] + np.arange(n)], np.array([i for _, i in found], dtype=np.int64), at))
        self.shortest = min(by, default=0)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of the suffixes of ``seq`` in the order of their first ``depth`` or more words."""
    rank = seq.astype(np.int64)
    k, n = 1, len(seq)
    while k < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2 + n) + after, return_inverse=True)
        if n == 0 or rank.max() == n - 1:
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def bounds(seq: np.ndarray, order: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of words: the range of ``order`` whose suffixes begin with it, by binary search."""
    n, wide = rows.shape
    padded = np.concatenate([seq, np.zeros(wide, seq.dtype)])
    step = np.arange(wide)

    def search(after: bool) -> np.ndarray:
        lo, hi = np.zeros(n, dtype=np.int64), np.full(n, len(order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            have, want = padded[order[mid][:, None] + step], rows[open_]
            differ = have != want
            at = differ.argmax(axis=1)
            some = differ[np.arange(len(open_)), at]
            less = some & (have[np.arange(len(open_)), at] < want[np.arange(len(open_)), at])
            right = less | (~some & after)
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)

    return search(False), search(True)


def shard(w: hashing.Words, probe: Probe) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words in the window, item, longest match) of every window found; words counted in the shard."""
    none = (np.zeros(0, dtype=np.int64),) * 4
    m = len(w.hash)
    if not m or not len(probe.vocabulary):
        return none
    at = np.searchsorted(probe.vocabulary, w.hash)
    at[at == len(probe.vocabulary)] = 0
    ids = np.where(probe.vocabulary[at] == w.hash, at + 1, 0).astype(np.int32)
    # runs of known words within a document
    new = np.zeros(m + 1, dtype=bool)
    new[w.first[:-1][w.first[:-1] < m]] = True
    known = ids > 0
    begins = np.flatnonzero(known & np.concatenate([[True], ~known[:-1]]) | known & new[:m])
    ends = np.flatnonzero(known & np.concatenate([~known[1:], [True]]) | known & np.concatenate([new[1:m], [True]])) + 1
    long = ends - begins >= probe.shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return none
    size = ends - begins + 1  # each run is followed by a separator
    off = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(begins, size)
    seq = ids[np.minimum(place, m - 1)].copy()
    seq[off[1:] - 1] = 0
    order = suffix_array(seq, max(n for n, *_ in probe.groups))
    found = []
    for n, rows, item, start in probe.groups:
        lo, hi = bounds(seq, order, rows)
        k = np.repeat(np.arange(len(rows)), hi - lo)
        if len(k):
            p = order[np.arange(len(k)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[k]]
            found.append((place[p], np.full(len(k), n), item[k], longest(seq, p, probe, start[k], n)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


def longest(seq: np.ndarray, p: np.ndarray, probe: Probe, s: np.ndarray, n: int) -> np.ndarray:
    """How many words match on from each place ``p`` of the shard and ``s`` of the test, ``n`` of which are known to."""
    size = np.full(len(p), n, dtype=np.int64)
    on = np.arange(len(p))
    while len(on):
        a, b = p[on] + size[on], s[on] + size[on]
        ok = (b < probe.last[s[on]]) & (a < len(seq))
        ok[ok] = seq[a[ok]] == probe.words[b[ok]]
        on = on[ok]
        size[on] += 1
    return size


HITS = "doc_id long, n_words long, n_hit long, spans array<struct<first:long,end:long>>, items array<long>, longest long"


def scan(docs: DataFrame, probe) -> DataFrame:
    """A row for each document: words, hit words, hit spans (in words), items, longest match."""

    def run(batches):
        p = probe.value
        for batch in batches:
            for i, j, data, off in hashing.blocks(batch.column(1), SHARD_BYTES):
                w = hashing.words(data, off, inside=hashing.ALNUM)
                n_words = np.diff(w.first)
                first, n, item, far = shard(w, p)
                doc = np.searchsorted(w.first, first, side="right") - 1
                spans = merged(first, first + n, doc, w.first, j - i)
                hit = [sum(b - a for a, b in s) for s in spans]
                items: list[list[int | None]] = [[] for _ in range(j - i)]
                for d, x in np.unique(np.stack([doc, item], axis=1), axis=0).tolist() if len(doc) else ():
                    items[d].append(p.names[x])
                most = np.zeros(j - i, dtype=np.int64)
                np.maximum.at(most, doc, far)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(n_words, pa.int64()),
                        pa.array(hit, pa.int64()),
                        pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                        pa.array(items, pa.list_(pa.int64())),
                        pa.array(most, pa.int64()),
                    ],
                    ["doc_id", "n_words", "n_hit", "spans", "items", "longest"],
                )

    return docs.mapInArrow(run, HITS)


def merged(a: np.ndarray, b: np.ndarray, doc: np.ndarray, first: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """Each document's spans of words, those that touch or overlap as one, counted from its first word."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = np.lexsort((b, a))
    a, b, doc = a[order], b[order], doc[order]
    if len(a):
        reach = np.maximum.accumulate(b)
        new = np.flatnonzero(np.concatenate([[True], (a[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]))
        for x, y, d in zip(a[new].tolist(), reach[np.append(new[1:], len(a)) - 1].tolist(), doc[new].tolist(), strict=True):
            out[d].append((x - int(first[d]), y - int(first[d])))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """HITS for every row of ``docs`` (doc_id, text) against all items of ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", "text").filter("text is not null")
    n_blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // cfg.block_chars))
    probes = []
    for k in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        probes.append(spark.sparkContext.broadcast(Probe([(r[0], r[1]) for r in own.toLocalIterator()], cfg.window)))
    if n_blocks == 1:
        return scan(docs, probes[0])
    rows = numbered(docs, "rows")
    own = rows.select(F.col("_row").alias("doc_id"), "text")
    parts = [cut(scan(own, p), "pass") for p in probes]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    cover = F.aggregate(
        F.sort_array(F.flatten(F.collect_list("spans"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["first"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
    )["n"]
    one = both.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), cover.alias("n_hit"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest")
    )
    one = one.withColumnRenamed("doc_id", "_id")
    return rows.select("doc_id", "_row").join(one, F.col("_row") == F.col("_id")).drop("_row", "_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """``docs`` without the contaminated rows, with all its columns.

    Each row is judged by its own text: rows without a doc_id, or of one doc_id, stay or go alone, and
    rows without a text stay.
    """
    row = unused(docs, "_row")
    rows = numbered(docs, "rows", row)
    own = rows.select(F.col(row).alias("doc_id"), "text")
    bad = contamination(own, benchmark, cfg).filter((F.col("n_hit") > 0) & (cfg.share * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = DecontamConfig()
    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), cfg)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (cfg.share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL for the rows of op4: windows of every length that items have, joined by their words.
SQL = f"""with i as (select item_id, {_WORDS} as w from benchmark), n as (select item_id, w, least(13, len(w)) as k from i where len(w) > 0),
 win as (select distinct item_id, k, array_to_string(w[s:s+k-1], ' ') as g from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as s from n)),
 t as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
 f as (select rid, k, s, array_to_string(w[s:s+k-1], ' ') as g from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as s from t, (select distinct k from n) where len(w) >= k)),
 h as (select rid, f.k, s, item_id from f join win on f.k = win.k and f.g = win.g),
 p as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(s, s + k)) as q from h) group by 1),
 m as (select rid, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct rid, item_id::varchar as x from h) group by 1)
 select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
 from t left join p using (rid) left join m using (rid)"""
