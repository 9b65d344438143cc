"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

Each text is the set of its distinct word shingles. A register holds, for one hash function over the
whole set, the number of leading zeros of the smallest value and the bits after its first one bit
(the mantissa): 2 bytes where a MinHash value takes 8. Every register sees every shingle, as texts of
a few words would leave most registers of a partitioned sketch empty.

Texts with equal sets are one class. Classes that share a band of registers are candidates; in every
bucket all classes are compared with one centre, so a bucket of n classes gives n - 1 pairs. Confirmed
links make components, and buckets that still hold several components are dealt with again under other
centres. What is left after these rounds is compared pair by pair across components, but for sets that
share too few shingles with all others to have a link, so no link that the bands found is lost. A pair is
verified on full sets only if the register estimate, corrected for chance collisions, allows it.

Null and empty texts have no shingles and link with nothing: each is its own component. Repeated rows
of one doc_id count as copies of it. Where rows have no doc_id, or one doc_id with different sets, rows are
told apart by numbers, each is linked by its own text, and a component's id is the smallest doc_id of its
rows: null if none has one, and a doc_id may be in several components. Equal sets are told by 128 bits of
hash. Columns other than the two named ones are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import cut, numbered, ship, table


@dataclass(frozen=True)
class NearConfig:
    """Similarity is ``percent``/100; a pair of that similarity misses all bands with a chance of 5e-6."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    mantissa: int = 11
    extra: int = 384  # registers beyond the bands', for estimates only
    slack: float = 0.105  # an estimate from 512 registers is this far off with a chance of about 1e-7
    rounds: int = 1
    broadcast_ids: int = 500_000  # up to so many ids (8 MB) find their texts without a shuffle of all texts

    @property
    def registers(self) -> int:
        return self.bands * self.rows + self.extra


def multipliers(n: int) -> np.ndarray:
    """Odd 32-bit factors, the same everywhere."""
    return (hashing.mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def registers(shingles: np.ndarray, at: np.ndarray, cfg: NearConfig) -> np.ndarray:
    """A row of registers for each set; sets lie one after another and begin at ``at`` (none is empty)."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(at), cfg.registers), dtype=np.uint32)
    for j, f in enumerate(multipliers(cfg.registers)):
        v = low * f
        v ^= high * (f ^ np.uint32(0x5BD1E994))
        out[:, j] = np.minimum.reduceat(v, at)
    return compressed(out, cfg.mantissa)


def compressed(least: np.ndarray, mantissa: int) -> np.ndarray:
    """Leading zeros above, then the ``mantissa`` bits that follow the first one bit."""
    exponent = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # bits in use
    zeros = 32 - exponent
    rest = (least.astype(np.int64) << (zeros + 1)) & 0xFFFFFFFF
    return ((zeros << mantissa) | (rest >> (32 - mantissa))).astype(np.uint16)


def chance(n: float, mantissa: int) -> float:
    """Chance that registers of two unrelated sets of about ``n`` shingles agree, summed over leading zeros."""
    k = np.arange(0, 33)
    x = 2.0 ** -(k + 1.0)
    none_below = np.exp(-n * x)  # no value under 2**-(k+1)
    some = 1 - np.exp(-n * x)
    return float(np.sum((none_below * some) ** 2) / 2.0**mantissa)


def sketches(docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """doc_id, n (set size), a and b (128-bit digest of the set), sig (registers, big-endian)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in hashing.blocks(batch.column(1)):
                sets = list(hashing.shingle_sets(hashing.words(data, off), cfg.words))
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                sig = [b""] * len(sets)
                a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[k] for k in full])
                    at = np.concatenate(([0], np.cumsum(size[full])[:-1]))
                    regs = registers(flat, at, cfg).astype(">u2")
                    a[full] = np.add.reduceat(hashing.mix(flat), at)
                    b[full] = np.add.reduceat(hashing.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    for k, r in zip(full, regs, strict=True):
                        sig[k] = r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sig, pa.binary())],
                    ["doc_id", "n", "a", "b", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long, sig binary")


def classes(sketched: DataFrame) -> DataFrame:
    """doc_id, n, rep (smallest doc_id with the same set), sig at the class's first row only."""
    some = sketched.filter("n > 0")
    reps = some.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    joined = some.join(reps, ["n", "a", "b"]).select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig"))
    none = sketched.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"), F.lit(None).cast("binary").alias("sig"))
    return joined.unionByName(none)


def banded(reps: DataFrame, cfg: NearConfig) -> DataFrame:
    """rep, band and key, a row for each band."""
    wide = 2 * cfg.rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", wide * b + 1, wide)) for b in range(cfg.bands)])
    return reps.select("rep", F.posexplode(keys).alias("band", "key"))


def first_shared(a: str, b: str, cfg: NearConfig):
    """The first band in which two signatures agree."""
    wide = 2 * cfg.rows
    same = F.transform(F.sequence(F.lit(0), F.lit(cfg.bands - 1)), lambda i: F.substring(F.col(a), i * wide + 1, F.lit(wide)) == F.substring(F.col(b), i * wide + 1, F.lit(wide)))
    return F.array_position(same, True) - 1


def likeness(a: str, b: str, cfg: NearConfig):
    """The share of registers in which two signatures agree; chance agreements only raise it."""
    same = F.filter(F.sequence(F.lit(0), F.lit(cfg.registers - 1)), lambda i: F.substring(F.col(a), i * 2 + 1, F.lit(2)) == F.substring(F.col(b), i * 2 + 1, F.lit(2)))
    return F.size(same) / cfg.registers


def plausible(pairs: DataFrame, reps: DataFrame, cfg: NearConfig) -> DataFrame:
    """The pairs (x, y) that sizes and collision-corrected register estimates leave possible."""
    percent, least, mantissa = cfg.percent, cfg.percent / 100 - cfg.slack, cfg.mantissa
    of = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    sized = pairs.join(of("y"), "y").join(of("x"), "x")
    sized = sized.filter((100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")))

    def likely(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, nx, sx, sy = (batch.column(c) for c in ("x", "y", "n_x", "sig_x", "sig_y"))
            a, b = (np.frombuffer(b"".join(v.as_py() for v in s), dtype=np.uint16).reshape(batch.num_rows, -1) for s in (sx, sy))
            same = (a == b).mean(axis=1)
            by = np.array([chance(float(n), mantissa) for n in np.unique(np.asarray(nx) // 64) * 64.0 + 1])
            at = np.searchsorted(np.unique(np.asarray(nx) // 64), np.asarray(nx) // 64)
            e = by[at]
            ok = (same - e) / (1 - e) >= least
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)), y.filter(pa.array(ok))], ["x", "y"])

    return sized.select("x", "y", "n_x", "sig_x", "sig_y").mapInArrow(likely, "x long, y long")


def matches(some: DataFrame, docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """The pairs (x, y) of a written table whose full sets have the similarity asked for.

    Each pair is joined with both texts, in the order of x, and compared on whole shingle sets.
    """
    percent, words_ = cfg.percent, cfg.words
    ids = some.select(F.col("x").alias("doc_id")).unionByName(some.select(F.col("y").alias("doc_id"))).distinct()
    docs = texts_of(ids, docs, cfg)

    def confirm(batches):
        for batch in batches:
            x, y, tx, ty = batch.columns
            ok = np.zeros(batch.num_rows, dtype=bool)
            last, kept = None, None
            xs = np.asarray(x)
            for k in range(batch.num_rows):
                if last != xs[k]:
                    last, kept = xs[k], one(tx.slice(k, 1), words_)
                other = one(ty.slice(k, 1), words_)
                common = len(np.intersect1d(kept, other, assume_unique=True))
                ok[k] = 100 * common >= percent * (len(kept) + len(other) - common)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)), y.filter(pa.array(ok))], ["x", "y"])

    text = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"t_{c}"))
    whole = some.join(text("y"), "y").join(text("x"), "x").select("x", "y", "t_x", "t_y")
    return whole.mapInArrow(confirm, "x long, y long")


def one(column: pa.Array, k: int) -> np.ndarray:
    data, off = hashing.texts(column)
    return next(hashing.shingle_sets(hashing.words(data, off), k))


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """v, c: the smallest vertex that each vertex of ``edges`` (x, y) reaches.

    Large-star then small-star steps on the edges until neither changes them; every step is an
    aggregate by vertex and an equi-join, cut to the shared folder.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    both = lambda e: e.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
    edges = cut(edges.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), tag)
    before = None
    while True:
        e = both(edges)
        large = e.join(least(e), "u").filter("v > u").select(F.col("m").alias("x"), F.col("v").alias("y")).filter("x <> y").distinct()
        down = large.select(F.col("y").alias("u"), F.col("x").alias("v"))  # each u with its smaller neighbours
        m = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(m, "u").select(F.col("m").alias("x"), F.col("v").alias("y")).filter("x <> y")
        edges = cut(small.unionByName(m.select(F.col("m").alias("x"), F.col("u").alias("y"))).distinct(), tag)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("y").alias("v"), F.col("x").alias("c")).unionByName(edges.select(F.col("x").alias("v"), F.col("x").alias("c"))).groupBy("v").agg(F.min("c").alias("c"))


def texts_of(ids: DataFrame, docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """One row of ``docs`` for each doc_id of ``ids``; few ids find their texts without a shuffle of all texts."""
    few = ids.count() <= cfg.broadcast_ids
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def shared_shingles(reps: DataFrame, docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """rep, s: how many of its shingles some other set of ``reps`` has too. No two sets share more than either's s."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            for i, j, data, off in hashing.blocks(batch.column(1)):
                sets = list(hashing.shingle_sets(hashing.words(data, off), cfg.words))
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], [len(x) for x in sets])), pa.array(flat)], ["rep", "h"])

    ids = cut(reps.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    every = texts_of(ids, docs, cfg).select("doc_id", "text").mapInArrow(run, "rep long, h long")
    common = every.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    return every.join(common, "h").groupBy("rep").agg(F.count(F.lit(1)).alias("s"))


def mixed(held: DataFrame) -> DataFrame:
    """The rows of ``held`` (key, c, ...) whose bucket holds several components."""
    keys = held.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("q")).filter("p <> q").select("key")
    return held.join(keys, "key")


def stars(held: DataFrame, weight: DataFrame | None, turn: int) -> DataFrame:
    """(x, y): every bucket's centre with each of its members in other components."""
    ranked = held.withColumn("w", F.lit(0)) if weight is None else held.join(weight, "rep")
    order = F.struct(-F.col("w"), F.xxhash64(F.lit(turn), "rep"), F.col("rep").alias("rep"), F.col("c").alias("c"))
    centre = ranked.groupBy("key").agg(F.min(order).alias("o")).select("key", F.col("o.rep").alias("x"), F.col("o.c").alias("cx"))
    return held.join(centre, "key").filter("c <> cx").select("x", F.col("rep").alias("y"))


def leftover(held: DataFrame, reps: DataFrame, docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """(x, y): all pairs of a bucket in different components that their sizes and shared shingles allow.

    Sets x and y share at most m = min(s_x, s_y) shingles, so their similarity is at most
    m / (n_x + n_y - m). What can't reach the asked for similarity even with the smallest set of its
    bucket is dropped before any pair is made; a pair is made in the first band that it shares only.
    """
    p = cfg.percent
    held = cut(held.join(reps.select("rep", "n"), "rep").join(shared_shingles(held, docs, cfg), "rep"), "shared")
    low = held.groupBy("key").agg(F.min("n").alias("low"))
    able = held.join(low, "key").filter(100 * F.col("s") >= p * (F.col("n") + F.greatest("low", "s") - F.col("s"))).drop("low")
    able = cut(mixed(able).join(reps.select("rep", "sig"), "rep"), "able")
    other = able.select("key", F.col("rep").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("sig").alias("gx"))
    m = F.least("s", "sx")
    near = (F.col("c") > F.col("cx")) & (100 * F.least("n", "nx") >= p * F.greatest("n", "nx")) & (100 * m >= p * (F.col("n") + F.col("nx") - m))
    near = near & (first_shared("sig", "gx", cfg) == F.col("band")) & (likeness("sig", "gx", cfg) >= p / 100 - cfg.slack)
    return able.join(other, (able.key == other.key) & near).select("x", F.col("rep").alias("y"))


def near_duplicates(docs: DataFrame, cfg: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sketched = cut(sketches(docs, cfg), "sketch")
    if not unclear(sketched).isEmpty():
        rows = numbered(docs, "near")
        found = linked(rows.select(F.col("_row").alias("doc_id"), "text"), None, cfg).select(F.col("doc_id").alias("_row"), "n_shingles", "class_id", "component_id")
        own = cut(rows.select("_row", "doc_id").join(found, "_row"), "own")
        for c in ("class_id", "component_id"):
            least = own.groupBy(c).agg(F.min("doc_id").alias("least"))
            own = own.join(least, c).drop(c).withColumnRenamed("least", c)
        return own.select("doc_id", "n_shingles", "class_id", "component_id")
    return linked(docs, sketched, cfg)


def unclear(sketched: DataFrame) -> DataFrame:
    """The doc_ids that don't tell rows apart: none at all, or one of rows with different sets."""
    one = F.struct("n", "a", "b")
    return sketched.groupBy("doc_id").agg(F.min(one).alias("p"), F.max(one).alias("q")).filter("doc_id is null or p <> q").select("doc_id")


def linked(docs: DataFrame, sketched: DataFrame | None, cfg: NearConfig) -> DataFrame:
    """The same, for documents that doc_id tells apart."""
    sketched = cut(sketches(docs, cfg), "sketch") if sketched is None else sketched
    member = cut(classes(sketched), "class")
    reps = member.filter("sig is not null").select("rep", "n", "sig").dropDuplicates(["rep"])
    bands = banded(reps, cfg)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    bands = cut(bands.join(shared, "key"), "bands")
    weight = bands.groupBy("rep").agg(F.sum("k").alias("w"))  # what has most company is likely what the rest was made from

    label = tested = None
    for turn in range(cfg.rounds + 1):
        if label is None:
            held = bands.select("rep", "band", "key", F.col("rep").alias("c"))
        else:
            held = cut(mixed(bands.join(label, bands.rep == label.v, "left").select("rep", "band", "key", F.coalesce("c", "rep").alias("c"))), "held")
            if held.isEmpty():
                break
        pairs = stars(held, weight if turn == 0 else None, turn) if turn < cfg.rounds else leftover(held, reps, docs, cfg)
        pairs = pairs.distinct()
        if tested is not None:
            again = tested.unionByName(tested.select(F.col("y").alias("x"), F.col("x").alias("y")))
            pairs = pairs.join(again, ["x", "y"], "left_anti")
        pairs = cut(pairs, "pairs")
        some = cut(plausible(pairs, reps, cfg), "likely") if turn < cfg.rounds else pairs
        found = cut(matches(some, docs, cfg), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if label is None else found.unionByName(label.select(F.col("c").alias("x"), F.col("v").alias("y")))
        label = cut(components(links), "label")
    return member.join(label, member.rep == label.v, "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("c", "rep").alias("component_id"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


#: DuckDB SQL for the rows of op8: all pairs that share a shingle, and the links' closure.
SQL = """with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 g as (select distinct doc_id, array_to_string(w[i:i+4], chr(1)) as gram from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from t where len(w) > 0)),
 n as (select doc_id, count(*) as n from g group by 1),
 o as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.gram = y.gram and x.doc_id < y.doc_id group by 1, 2),
 e as (select a, b from o join n p on a = p.doc_id join n q on b = q.doc_id where 100 * c >= 75 * (p.n + q.n - c)),
 s as (select a as u, b as v from e union select b, a from e),
 walk as (select doc_id as v, doc_id as c from documents union select s.v, walk.c from walk join s on s.u = walk.v),
 l as (select v, min(c) as c from walk group by v)
 select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id, c = d.doc_id as kept from documents d join l on l.v = d.doc_id left join n on n.doc_id = d.doc_id"""
