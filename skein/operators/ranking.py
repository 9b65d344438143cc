"""Latest rows, tiers, facets, top-k, populations and other orders with stated ties."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import numbers as N
from skein.session import ship

NOT_STATED = "(not stated)"


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def stated(column: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(NOT_STATED))


def facet(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """value, n, rank of the ``top`` stated values, the rest as "(other)", and what isn't stated, last."""
    counts = df.groupBy(stated(F.col(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.filter(F.col("value") != NOT_STATED)
    ranked = known.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("value"))))
    shown = ranked.filter(F.col("rank") <= top)
    rest = ranked.filter(F.col("rank") > top).agg(F.sum("n").alias("n")).filter("n is not null").select(F.lit("(other)").alias("value"), "n", F.lit(top + 1).alias("rank"))
    none = counts.filter(F.col("value") == NOT_STATED).select("value", "n", F.lit(top + 2).alias("rank"))
    return shown.unionByName(rest).unionByName(none)


def title_tier(title: Column, query: str) -> Column:
    """0 for the same title, 1 for one that begins with the query, 2 for one that contains it, else null."""
    t, q = F.lower(title), query.lower()
    return F.when(t == q, 0).when(F.startswith(t, F.lit(q)), 1).when(F.contains(t, F.lit(q)), 2)


def merged_passes(passes: list[DataFrame], key: str) -> DataFrame:
    """Passes in their order, each (key, rank, ...); a key stays in its first pass only."""
    every = None
    for i, p in enumerate(passes):
        q = p.withColumn("pass_no", F.lit(i))
        every = q if every is None else every.unionByName(q)
    return latest(every, [key], F.asc("pass_no"), F.asc("rank"))


def top_k_cosine(rows: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to a query vector: one pass, a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, N.cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(k)


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest values of each row, ties by column; -inf is none."""
    k = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))  # more than k where values tie
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    n = np.bincount(row, minlength=len(s))
    on = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < k
    return row[on], col[on]


def neighbours_in_bucket(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", bucket: str = "label", block: int = 8192) -> DataFrame:
    """(key, other, score, rank): the ``k`` nearest others in the same bucket, exactly, ties by id.

    A bucket is cut into blocks by a hash of the id, about ``block`` rows each, so a bucket of any size
    is spread over tasks. Every two of its blocks meet once, as matrix products of 256 query rows that give
    ``k`` rows for each; the best of these are the answer. No pair of rows is ever a row of its own.
    Vectors move in their own type, once for each block of their bucket and side.
    """
    count = F.count(F.lit(1))
    sizes = rows.groupBy(bucket).agg(F.ceil(count / block).cast("int").alias("_n"))
    v = rows.select(F.col(key).cast("long").alias("_k"), F.col(bucket).alias("_g"), F.col(vector).alias("_v")).join(sizes.withColumnRenamed(bucket, "_g"), "_g")
    v = v.withColumn("_b", F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    ask = v.select("_g", "_k", "_v", "_b", every.alias("_o"))
    have = v.select(F.col("_g").alias("g2"), F.col("_k").alias("k2"), F.col("_v").alias("v2"), F.col("_b").alias("o2"), every.alias("b2"))

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = ["_k", "other", "score"]
        if q.empty or c.empty:
            return pd.DataFrame([], columns=names)
        c = c.sort_values("k2", kind="stable")
        unit = lambda x: (m := np.stack(x.to_numpy()).astype(np.float64)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, near, x, y = q["_k"].to_numpy(), c["k2"].to_numpy(), unit(q["_v"]), unit(c["v2"]).T
        out = []
        for a in range(0, len(x), 256):
            s = np.round(x[a : a + 256] @ y, 12)
            s[ids[a : a + 256, None] == near[None, :]] = -np.inf
            row, col = best_of(s, k)
            out.append(pd.DataFrame({"_k": ids[a + row], "other": near[col], "score": s[row, col]}))
        return pd.concat(out)

    ship(rows.sparkSession)
    best = ask.groupBy("_g", "_b", "_o").cogroup(have.groupBy("g2", "b2", "o2")).applyInPandas(nearest, "_k long, other long, score double")
    w = Window.partitionBy("_k").orderBy(F.desc("score"), F.asc("other"))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("_k", key)


def histogram(df: DataFrame, value: str, width: float, bins: int) -> DataFrame:
    """bin, n for every bin, the empty ones too."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(N.histogram_bin(F.col(value), width, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values that follow each other: by, run, value, first, last, n."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*by, "run").agg(F.min(value).alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def hash_chain(df: DataFrame, by: list[str], order: list[str], payload: Column, raw: bool = True) -> DataFrame:
    """Every row's hash over the hash before it and its own payload, within its partition of the log.

    The fold is sequential by nature: a key's rows come to one task, sorted (spilled to disk where they
    are many), and stream through it with nothing kept but the last hash. The first row's predecessor
    is the byte 0. ``raw``: over the hash's bytes, else over its hexadecimal digits.
    """
    ship(df.sparkSession)
    names = [*by, *order]
    rows = df.select(*names, payload.cast("binary").alias("_payload")).repartition(*by).sortWithinPartitions(*names)
    n = len(by)

    def run(batches):
        start = b"\0" if raw else b"00"
        key, last = None, start
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(n)), strict=True))
            out = []
            for k, p in zip(keys, batch.column(len(names)).to_pylist(), strict=True):
                if k != key:
                    key, last = k, start
                one = hashlib.sha256(last + (p or b""))
                last = one.digest() if raw else one.hexdigest().encode()
                out.append(one.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], [*names, "row_hash"])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{types}, row_hash string")
