"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature at a time, on binned values, so that each feature ends
as one lookup table; then trees on the most useful pairs of features give tables over pairs of bins. A
score is the sum of a few table entries through a logistic function, computed for whole batches at once.

Features are shape statistics of the whole text; ids, language, source and labels are never inputs.
A null text is an empty one: all its features are 0 and it gets a score like any other. The fit takes
``max_rows`` labelled rows at most, chosen by a hash of their id (a documented bound); labels that are
null are left out, a document labelled twice counts twice. Without labels of both kinds the score is
the smoothed share of label 1. Repeated rows are scored each; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import cut, ship, table

FEATURES = (
    "log_words", "word_length", "symbols", "stutter", "distinct", "capitals", "pipes", "shouts", "digits", "sentence_ends",
    "dup_lines", "repeats", "short_words", "log_longest", "other_bytes",
)


@dataclass(frozen=True)
class GamConfig:
    max_rows: int = 20_000
    bins: int = 32
    rounds: int = 200
    rate: float = 0.1
    pairs: int = 6
    pair_bins: int = 8
    pair_rounds: int = 40
    ridge: float = 2.0


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    w = hashing.words(data, off, lower=False)
    n_texts = len(off) - 1
    out = np.zeros((n_texts, len(FEATURES)))
    if not len(data):
        return out

    def per_text(on: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(on, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    def per_words(on: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(on, dtype=np.int64)])
        return total[w.first[1:]] - total[w.first[:-1]]

    n = np.diff(w.first)
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(off), 1)
    text = np.repeat(np.arange(n_texts), n)
    symbol = np.zeros(256, dtype=bool)
    symbol[[ord(c) for c in "#*$%&|<>"]] = True
    upper, lower = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    upper[65:91] = lower[97:123] = True
    up = per_text(upper[data])
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    length = w.end - w.start
    ends = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    out[:, 0] = np.log1p(n)
    out[:, 1] = per_words(length) / some
    out[:, 2] = per_text(symbol[data]) / some
    out[:, 3] = per_words(same) / some
    out[:, 5] = up / np.maximum(up + per_text(lower[data]), 1)
    out[:, 6] = per_text(data == 124) / some
    out[:, 7] = per_text(data == 33) / some
    out[:, 8] = per_text((data >= 48) & (data < 58)) / size
    out[:, 9] = per_words((ends == 46) | (ends == 63)) / some
    out[:, 12] = per_words(length <= 3) / some
    out[:, 14] = per_text(data >= 128) / size
    longest = np.zeros(n_texts)
    np.maximum.at(longest, text, length)
    out[:, 13] = np.log1p(longest)
    grams = hashing.shingles(w.hash, 5)
    for k in range(n_texts):
        a, b = w.first[k], w.first[k + 1]
        if b > a:
            out[k, 4] = len(np.unique(w.hash[a:b])) / (b - a)
        if b - a > 5:
            own = grams[a : b - 4]
            out[k, 11] = 1 - len(np.unique(own)) / len(own)
    # lines: a line's hash is the sum of its words' hashes times their places
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, w.start) + text * (len(breaks) + 1)
    if len(line):
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        place = (np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        h = np.add.reduceat(w.hash * place, first)
        of = text[first]
        key = h ^ hashing.mix(of.astype(np.uint64))
        _, at = np.unique(key, return_index=True)
        out[:, 10] = 1 - np.bincount(of[at], minlength=n_texts) / np.maximum(np.bincount(of, minlength=n_texts), 1)
        out[n == 0, 10] = 0
    return out


class Gam:
    """Cut points, a table for each feature, tables for pairs, and the base."""

    def __init__(self, base: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.cuts, self.tables, self.pairs = base, cuts, tables, pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += t[np.searchsorted(c, x[:, j], side="right")]
        for i, j, ci, cj, t in self.pairs:
            z += t[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cut_points(v: np.ndarray, bins: int) -> np.ndarray:
    """Between-value quantiles, so that ties fall in one bin."""
    u = np.unique(v)
    if len(u) <= bins:
        return (u[1:] + u[:-1]) / 2
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def step(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """The values of a tree over ordered bins with gradient and curvature sums g, h: best splits, greedily."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                won = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(won.argmax())
                best = max(best, (float(won[k]), int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, cfg: GamConfig = GamConfig()) -> Gam:
    """Cyclic boosting of the features' tables, then of the tables of the pairs that explain most of what is left."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Gam(base, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    cuts = [cut_points(x[:, j], cfg.bins) for j in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), base)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(cfg.rounds):
        for j, b in enumerate(at):
            g, h = slope()
            t = cfg.rate * step(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])), cfg.ridge)
            tables[j] += t
            z += t[b]
    coarse = [cut_points(x[:, j], cfg.pair_bins) for j in range(x.shape[1])]
    small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    g, h = slope()
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            k, cells = small[i] * (len(coarse[j]) + 1) + small[j], (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
            found.append((float((np.bincount(k, g, cells) ** 2 / (np.bincount(k, h, cells) + cfg.ridge)).sum()), i, j))
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(found, reverse=True)[: cfg.pairs]]
    for _ in range(cfg.pair_rounds):
        for i, j, ci, _, t in pairs:
            g, h = slope()
            shape = t.shape
            k = small[i] * shape[1] + small[j]
            gg, hh = np.bincount(k, g, t.size).reshape(shape), np.bincount(k, h, t.size).reshape(shape)
            # a tree of depth two: the split along i after which splits along j on either side gain most
            best, add = -1.0, np.zeros(shape)
            for side in range(1, shape[0]):
                own, won = np.empty(shape), 0.0
                for part in (slice(0, side), slice(side, shape[0])):
                    g1, h1 = gg[part].sum(0), hh[part].sum(0)
                    own[part] = v = step(g1, h1, cfg.ridge, 2)
                    won += float((v * g1 - v * v * (h1 + cfg.ridge / shape[1]) / 2).sum())
                if won > best:
                    best, add = won, own
            t += cfg.rate * add
            z += cfg.rate * add.ravel()[k]
    return Gam(base, cuts, tables, pairs)


def featured(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """id (the column ``by``), doc_id and x, the features, of every row."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in hashing.blocks(batch.column(2)):
                x = features(data, off)
                flat = pa.array(x.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).cast(pa.int64()) for c in (0, 1)), lists], ["id", "doc_id", "x"])

    return docs.select(F.col(by).alias("id"), "doc_id", "text").mapInArrow(run, "id long, doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from the fit; one without a doc_id isn't held out, nor has it labels."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, cfg: GamConfig = GamConfig()) -> Gam:
    """The model from featured rows and their labels (doc_id, quality), held-out ids left out."""
    own = labels.select("doc_id", F.col("quality").alias("y")).filter(F.col("y").isNotNull() & ~held_out())
    some = rows.join(own, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(cfg.max_rows).select("x", "y")
    got = some.toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.asarray(got.column("y"), dtype=np.float64), cfg)


def scored(rows: DataFrame, model: Gam) -> DataFrame:
    """id, score of featured rows: bin look-ups and additions on whole batches."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(x))], ["id", "score"])

    return rows.select("id", "x").mapInArrow(run, "id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, cfg: GamConfig = GamConfig(), by: str = "doc_id") -> DataFrame:
    """id (the column ``by``) and score for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality)."""
    ship(docs.sparkSession)
    rows = cut(featured(docs, by), "features")
    return scored(rows, train(rows, labels, cfg))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
