"""Substring dedup: sliding runs of consecutive sentences, hashed, joined globally, non-first ones removed.

A sentence ends at a word that ends in . ! ? (closing quotes or brackets may follow) or at a line
break. Every ``long`` consecutive words without either are cut after the one of the smallest hash (the
latest of equals), so no sentence is longer and a cut depends on fewer than ``long`` words to each side:
a repeated passage is cut alike wherever it stands, but for its edges, and 5 * ``long`` + 6 common words
or more hold a common run. Up to 2 * ``long`` words at an edge of a passage can stay. A run is the fewest consecutive sentences, two or more, that hold ``min_words`` words, counted
both from each sentence on and back from each sentence; so every sentence of a repeated passage lies in
a run within the passage. Runs are compared by 128 bits of hash of their words, A-Z in lower case: among
10^13 runs, two different ones agree with a chance of about 10^-13.

The first occurrence of a run, by doc_id and then place, stays; sentences covered by any later one go,
within one document too. Rows of the same doc_id count as one document's first row and copies: their
places tie and are kept alike. Null and empty texts have no sentences and come back empty; rows
without a doc_id have no place in the order and come back whole. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import cut, ship, table


@dataclass(frozen=True)
class SpanConfig:
    min_words: int = 16
    least: int = 2
    long: int = 8


_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True  # ! . ?
_CLOSE = np.zeros(256, dtype=bool)
_CLOSE[[34, 39, 41, 93, 125]] = True  # quotes and brackets


def sentences(w: hashing.Words, data: np.ndarray, cfg: SpanConfig) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence of a block (plus the number of words), and each text's first sentence (plus all)."""
    m = len(w.hash)
    last = np.zeros(m, dtype=bool)
    if m:
        e = w.end - 1
        last = _STOP[data[e]] | _CLOSE[data[e]] & _STOP[data[np.maximum(e - 1, w.start)]]
        lines = np.flatnonzero(data == 10)
        upto = np.searchsorted(lines, w.start)
        last[:-1] |= upto[1:] > upto[:-1]
        last[w.first[1:][w.first[1:] > 0] - 1] = True
        last[cuts(w.hash, last, cfg.long)] = True
    begin = np.concatenate([np.zeros(1, dtype=np.int64), np.flatnonzero(last) + 1]) if m else np.zeros(1, dtype=np.int64)
    return begin, np.searchsorted(begin, w.first)


def cuts(h: np.ndarray, last: np.ndarray, long: int) -> np.ndarray:
    """The word of the smallest hash, the latest of equals, in every ``long`` words without a natural end."""
    ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(last)])
    free = np.flatnonzero(ends[long:] == ends[: len(ends) - long]) if len(h) >= long else np.zeros(0, dtype=np.int64)
    at, best = free.copy(), h[free]
    for k in range(1, long):
        x = h[free + k]
        less = x <= best
        best[less] = x[less]
        at[less] = free[less] + k
    return at


def runs(begin: np.ndarray, first: np.ndarray, cfg: SpanConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of the runs of all texts of a block, in sentences of the block, each once."""
    n = len(begin) - 1
    if n <= 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    i = np.arange(n)
    to = np.maximum(np.searchsorted(begin, begin[i] + cfg.min_words), i + cfg.least)
    ok = to <= first[text + 1]
    frm = np.minimum(np.searchsorted(begin, begin[i + 1] - cfg.min_words, side="right") - 1, i + 1 - cfg.least)
    ok2 = (frm >= first[text]) & (frm >= 0)
    pairs = np.unique(np.concatenate([i[ok] * (n + 2) + to[ok], frm[ok2] * (n + 2) + i[ok2] + 1]))
    a, b = pairs // (n + 2), pairs % (n + 2)
    return text[a], a, b


def run_hashes(w: hashing.Words, begin: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the words of each run, as two hashes."""
    up, down = hashing._powers(len(w.hash) + 1)
    out = []
    for h in (w.hash, hashing.mix(w.hash ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
        out.append(hashing.mix((total[begin[b]] - total[begin[a]]) * down[begin[a]]) + (begin[b] - begin[a]).astype(np.uint64))
    return out[0], out[1]


def hashed_runs(docs: DataFrame, cfg: SpanConfig) -> DataFrame:
    """doc_id, h and g (128 bits of hash) and at (first sentence and length of the run, in one long) for every run of every text."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            for i, _, data, off in hashing.blocks(batch.column(1)):
                w = hashing.words(data, off)
                begin, first = sentences(w, data, cfg)
                text, a, b = runs(begin, first, cfg)
                h, g = run_hashes(w, begin, a, b)
                place = ((a - first[text]) << 31) | (b - a)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids[i + text]), pa.array(place)], ["h", "g", "doc_id", "at"])

    return docs.mapInArrow(run, "h long, g long, doc_id long, at long")


def repeated(docs: DataFrame, cfg: SpanConfig = SpanConfig()) -> DataFrame:
    """doc_id, spans: the sentence spans (from and length in one long) that a non-first run covers."""
    every = hashed_runs(docs.filter("doc_id is not null"), cfg)
    firsts = every.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "at")).alias("f")).filter("n > 1").select("h", "g", F.col("f.doc_id").alias("fd"), F.col("f.at").alias("fa"))
    later = every.join(cut(firsts, "firsts"), ["h", "g"]).filter("doc_id <> fd or at <> fa")
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("spans"))


def cleaned(docs: DataFrame, cfg: SpanConfig = SpanConfig()) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed ("start:end" in code points), text (without them) of every row."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = cut(repeated(docs, cfg), "repeated")
    joined = docs.join(found, "doc_id", "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for i, j, data, off in hashing.blocks(batch.column(1)):
                w = hashing.words(data, off)
                begin, first = sentences(w, data, cfg)
                spans = batch.column(2).slice(i, j - i)
                out: list[tuple[int, int, str, str]] = []
                for k in range(j - i):
                    n = int(first[k + 1] - first[k])
                    raw = data[off[k] : off[k + 1]].tobytes()
                    if not spans[k].is_valid:
                        out.append((n, 0, "", raw.decode()))
                        continue
                    gone = np.zeros(n + 1, dtype=np.int64)
                    for s in spans[k].as_py():
                        gone[s >> 31] += 1
                        gone[(s >> 31) + (s & 0x7FFFFFFF)] -= 1
                    gone = np.cumsum(gone[:n]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    kept, places, at, point = [], [], 0, 0
                    for a, b in zip(edge[::2], edge[1::2], strict=True):
                        lo = int(w.start[begin[first[k] + a]] - off[k])
                        hi = int(w.end[begin[first[k] + b] - 1] - off[k])
                        kept.append(raw[at:lo].decode())
                        point += len(kept[-1])
                        size = len(raw[lo:hi].decode())
                        places.append(f"{point}:{point + size}")
                        point, at = point + size, hi
                    kept.append(raw[at:].decode())
                    out.append((n, int(gone.sum()), ",".join(places), "".join(kept).strip(" \t\n\v\f\r")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), *(pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))],
                    ["doc_id", "n_sentences", "n_removed", "removed", "text"],
                )

    return joined.mapInArrow(run, "doc_id long, n_sentences long, n_removed long, removed string, text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents"))
