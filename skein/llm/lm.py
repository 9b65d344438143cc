"""Language-model scores: a causal self-attention model over subword ids, beside whole-corpus counts.

Words (runs without ASCII white space, A-Z in lower case) are cut into subword ids, each with a leading
space. The model predicts each id from the ids before it, in three factors: the class of the next id,
its bucket within the class, and the id within its bucket. The last two are counts over all training
documents, of buckets after buckets and of ids. The class is a softmax of two terms: the log of its
count-based probability after the last bucket, and what one head of masked self-attention over a window
of context adds. Classes are clusters of buckets that occur after the same buckets, found in the counts,
so context can shift whole groups of ids, as those of a language. Every factor is a distribution, so
scores are log-probabilities, and the model starts from what counts alone give.

Training documents are all whose hash remainder isn't the held-out one. Counts are gathered by
partial sums and grow with the input. The network's weights come from every window of every training
document, each seen once: the windows are dealt at random into ``parts`` of growing size, and for one
part after another tasks stream over their own windows, in gradient steps from the same start, and
their weights are averaged by the windows seen.

Scoring cuts each text into windows of ``2 * stride`` ids that overlap by half; the later half is scored,
so each id is scored once, with at least ``stride`` ids of context where the text has them, as one
batch of masked attention. The end of the text is an id like any other. Every id has some probability;
one that would be under 1e-30 counts as 1e-30.

The base score is a unigram model over words with one added. Words seen at least N/``frequent`` times,
so ``frequent`` at most, are sent to the tasks; all other occurrences meet their counts in a join.

The gradient and the classes' probabilities are graphs of ``graphs``; where onnxruntime is missing, numpy
gives the same but for the order of sums.

A null or empty text has no words: its one token is the end. Without training documents N and V are 0
and the base score is 0. Repeated rows are scored each; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs, hashing
from .common import cut, ship, table

END = np.uint64(0)  # stands for the end token among word hashes
_MISSING = itertools.repeat(-1)
_ODD = re.compile(r"[^\S ]")
_COUNTS = "kind int, key long, n long, w binary"


@dataclass(frozen=True)
class LmConfig:
    modulus: int = 7
    left_out: int = 2
    frequent: int = 2_000_000  # words sent to tasks at most (32 MB)
    buckets: int = 1024  # ids that share an embedding: the most frequent alone, the rest by remainder
    alone: int = 896
    classes: int = 64
    dim: int = 16
    stride: int = 16
    piece: int = 16  # windows that lie together in a gradient step
    parts: tuple[int, ...] = (1, 1, 2, 4)  # shares of the windows between two averagings
    steps_of: int = 256  # windows in a gradient step
    rate: float = 0.04
    cache: int = 1_000_000  # words whose ids a worker remembers
    tokenizer: str | None = None  # a ranks file of the tiktoken library; None: the public byte_bpe_50k


# ---- words and ids --------------------------------------------------------------------------------


class Subwords:
    """Ids of words, remembered by the words' hashes."""

    def __init__(self, path: str, most: int):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.n = len(ranks) + 1
        self.end = len(ranks)  # the id that is free
        self.code = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.array([t[:1] == b" " for t, _ in sorted(ranks.items(), key=lambda x: x[1])] + [False])
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.at, self.size, self.used, self.fill = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0, 0
        self.pool = np.zeros(1 << 18, np.uint16)

    def encode_all(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie in ``raw``, each after a space, and how many each has.

        Words don't hold spaces and ids don't cross them, so one call encodes all; an id that begins
        with a space begins a word. Where words hold other white space, each is encoded alone.
        """
        text = raw.tobytes().decode()
        if not _ODD.search(text):
            ids = np.asarray(self.code.encode_to_numpy(text, disallowed_special=()))
            at = np.flatnonzero(self.spaced[ids])
            if len(at) == len(size):
                return ids, np.diff(np.append(at, len(ids)))
        each = [self.code.encode_ordinary(f" {w}") for w in text[1:].split(" ")]
        return np.array([i for e in each for i in e], dtype=np.int64), np.array([len(e) for e in each])

    def learn(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        size = end - start
        total = np.concatenate([[0], np.cumsum(size + 1)])
        raw = np.full(total[-1], 32, dtype=np.uint8)
        place = np.arange(int(size.sum())) - np.repeat(total[:-1] - np.arange(len(size)), size)
        raw[np.repeat(total[:-1] + 1, size) + place] = hashing.LOWER[data[np.repeat(start, size) + place]]
        ids, n = self.encode_all(raw, size)
        k = len(size)
        while self.used + k > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.fill + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.fill : self.fill + len(ids)] = ids
        self.at[self.used : self.used + k] = self.fill + np.cumsum(n) - n
        self.size[self.used : self.used + k] = n
        self.slot.update(zip(hashes.tolist(), range(self.used, self.used + k), strict=True))
        self.fill += len(ids)
        self.used += k

    def ids(self, w: hashing.Words, data: np.ndarray, unique: np.ndarray, where: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's words, and how many each text has. unique, where, back: of ``distinct``."""
        if self.used > self.most:
            self.forget()
        slots = np.fromiter(map(self.slot.get, unique.tolist(), _MISSING), dtype=np.int32, count=len(unique))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self.used + np.arange(len(new))
            self.learn(unique[new], w.start[where[new]], w.end[where[new]], data)
        at, size = self.at[slots], self.size[slots]  # of the distinct words, which are fewer
        n = size[back]
        total = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=total[1:])
        # places in the pool: one more than the last, but for a word's first
        step = np.ones(total[-1], dtype=np.int32)
        if len(n):
            start = at[back]
            step[total[0]] = start[0]
            step[total[1:-1]] = start[1:] - (start[:-1] + n[:-1] - 1)
        return self.pool[np.cumsum(step, dtype=np.int32)], np.diff(total[w.first])


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, a place of each, which of them every element is, and how often each occurs."""
    order = np.argsort(h)
    s = h[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    back = np.empty(len(s), dtype=np.int64)
    back[order] = np.cumsum(first) - 1
    return s[at], order[at], back, np.diff(np.append(at, len(s)))


_SUBWORDS: dict[tuple, Subwords] = {}


def subwords(cfg: LmConfig) -> Subwords:
    import public_tokenizers

    key = (cfg.tokenizer, cfg.cache)
    if key not in _SUBWORDS:
        _SUBWORDS[key] = Subwords(cfg.tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), cfg.cache)
    return _SUBWORDS[key]


def held_out(cfg: LmConfig, doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(cfg.modulus)) == cfg.left_out, F.lit(False))


class Sums:
    """Counts by key, merged when they have grown."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.rows += len(keys)
        if self.rows > 3_000_000:
            self.parts = [self.merged()]
            self.rows = len(self.parts[0][0]) // 2  # so that merges stay rare when most keys are new

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, n = np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(n, at)


def count_batches(kind: int, keys: np.ndarray, n: np.ndarray):
    for k in range(0, len(keys), 200_000):
        part = keys[k : k + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[k : k + 200_000]), pa.nulls(len(part), pa.binary())], ["kind", "key", "n", "w"])


def pieces(flat: np.ndarray, n: np.ndarray, end: int, cfg: LmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's texts, each between two end ids, in pieces of ``piece`` windows: ids, sizes, whether context leads.

    A piece holds the ids that its windows are given and the one after; but for a text's first piece, the
    ids of the window before it lead, as context only.
    """
    s, long = cfg.stride, cfg.piece * cfg.stride
    off = np.concatenate([[0], np.cumsum(n + 2)])
    every = np.full(off[-1], end, dtype=np.int64)
    text = np.repeat(np.arange(len(n)), n)
    every[np.arange(len(flat)) + 2 * text + 1] = flat
    count = -(-(n + 1) // long)
    of = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * long
    lead = at > 0
    begin = at - s * lead
    size = np.minimum(at + long, n[of] + 1) + 1 - begin
    return every[spread(size, off[of] + begin)], size, lead


def spread(size: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every run of ``size`` places, one run after another."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def packed(flat: np.ndarray, size: np.ndarray, lead: np.ndarray) -> bytes:
    """Pieces as one value: how many, each one's size, whether context leads it, and all ids."""
    return np.uint32(len(size)).tobytes() + size.astype("<u4").tobytes() + lead.astype("u1").tobytes() + flat.astype("<u2").tobytes()


def unpacked(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u2", offset=4 + 5 * k), np.frombuffer(raw, "<u4", k, 4).astype(np.int64), np.frombuffer(raw, "u1", k, 4 + 4 * k) > 0


def gathered(docs: DataFrame, cfg: LmConfig) -> DataFrame:
    """What one pass over the training documents gives, in the columns of ``_COUNTS``.

    kind 0 and 1: a task's counts of words and of subword ids (key, n). kind 3: a block's pieces of part
    ``key``, in a random order, so that a gradient step isn't one long text's.
    """

    def run(batches):
        code, words_ = subwords(cfg), Sums()
        ids_ = np.zeros(code.n, dtype=np.int64)
        r = np.random.default_rng(7)
        shares = np.cumsum(cfg.parts) / sum(cfg.parts)
        for batch in batches:
            for _, _, data, off in hashing.blocks(batch.column(0)):
                w = hashing.words(data, off)
                unique, where, back, n = distinct(w.hash)
                words_.add(unique, n)
                flat, each = code.ids(w, data, unique, where, back)
                ids_ += np.bincount(flat, minlength=code.n)
                words_.add(np.array([END]), np.array([len(off) - 1]))
                ids_[code.end] += len(off) - 1
                flat, size, lead = pieces(flat, each, code.end, cfg)
                begin, order, at = np.cumsum(size) - size, r.permutation(len(size)), 0
                for part, to in enumerate((shares * len(order)).round().astype(int)):
                    own = order[at:to]
                    at = to
                    if len(own):
                        value = packed(flat[spread(size[own], begin[own])], size[own], lead[own])
                        yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.array([value], pa.binary())], ["kind", "key", "n", "w"])
        yield from count_batches(0, *words_.merged())
        some = np.flatnonzero(ids_)
        yield from count_batches(1, some.astype(np.uint64), ids_[some])

    return docs.filter(~held_out(cfg)).select("text").mapInArrow(run, _COUNTS)


# ---- the model ------------------------------------------------------------------------------------


class Channels:
    """What counts of ids give: their buckets, and the probability of each within its bucket."""

    def __init__(self, counts: np.ndarray, cfg: LmConfig):
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.bucket = np.empty(n, np.int32)
        self.bucket[order[: cfg.alone]] = np.arange(min(cfg.alone, n))
        rest = order[cfg.alone :]
        self.bucket[rest] = cfg.alone + rest % (cfg.buckets - cfg.alone)
        smooth = counts + 1e-2
        self.in_bucket = (smooth / np.bincount(self.bucket, smooth, cfg.buckets)[self.bucket]).astype(np.float32)
        self.unigram = np.bincount(self.bucket, smooth, cfg.buckets) / smooth.sum()


class Follow:
    """What counts of bucket pairs give: the classes of buckets, of the class after a bucket, of the bucket in it."""

    def __init__(self, pairs: np.ndarray, unigram: np.ndarray, cfg: LmConfig):
        after = (pairs + 32 * unigram) / (pairs.sum(1, keepdims=True) + 32)  # the unigram as 32 further counts
        self.cls = clustered(after, unigram, cfg.classes)
        of = np.zeros((cfg.buckets, cfg.classes))
        of[np.arange(cfg.buckets), self.cls] = 1
        self.prior = np.maximum(after @ of, 1e-12).astype(np.float32)  # class after bucket
        self.log_prior = np.log(self.prior)
        self.within = (after / self.prior[:, self.cls]).astype(np.float32)  # bucket in its class, after bucket


def clustered(after: np.ndarray, unigram: np.ndarray, k: int) -> np.ndarray:
    """Buckets in ``k`` classes of those that are likely after the same buckets: k-means on leading directions."""
    lift = np.log1p(after / np.maximum(unigram, 1e-12)[None, :]) * np.sqrt(unigram)[:, None]
    _, size, right = np.linalg.svd(lift, full_matrices=False)
    x = (right[:12] * size[:12, None]).T
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = x[np.argsort(-unigram, kind="stable")[:k]].copy()
    for _ in range(15):
        at = (x @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return at


def start_weights(cfg: LmConfig) -> dict[str, np.ndarray]:
    """Embeddings, their maps to key, value, query and own term, the map to classes, and the terms for distance."""
    r = np.random.default_rng(5)
    some = lambda size, *shape: (r.standard_normal(shape) * size).astype(np.float32)
    b, d, c = cfg.buckets + 1, cfg.dim, cfg.classes
    return {"e": some(0.3, b, d), "w": some(d**-0.5, d, 4 * d), "u": np.zeros((d, c), np.float32), "c": np.zeros(c, np.float32), "near": np.zeros(2 * cfg.stride, np.float32)}


def chunks(flat: np.ndarray, n: np.ndarray, bucket: np.ndarray, end: int, cfg: LmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts of a block: inputs (last and this stride, as buckets), targets (ids; -1 is none), text.

    A text's inputs are the end id and then its ids; its targets its ids and then the end id.
    """
    s, texts = cfg.stride, len(n)
    size = n + 1
    rows = -(-size // s)
    first = np.concatenate([[0], np.cumsum(rows)])
    total = np.concatenate([[0], np.cumsum(n)])
    target = np.full(first[-1] * s, -1, dtype=np.int32)
    ids = np.arange(total[-1])
    ids += np.repeat(first[:-1] * s - total[:-1], n)
    target[ids] = flat
    target[first[:-1] * s + n] = end
    given = np.full(first[-1] * s, cfg.buckets, dtype=np.int32)  # buckets: none
    ids += 1  # n + 1 places, so there is room
    given[ids] = bucket[flat]
    given[first[:-1] * s] = bucket[end]
    given = given.reshape(-1, s)
    before = np.full_like(given, cfg.buckets)
    before[1:] = given[:-1]
    before[first[:-1]] = cfg.buckets
    return np.concatenate([before, given], axis=1), target.reshape(-1, s), np.repeat(np.arange(texts), rows)


@functools.cache
def causal(s: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the 2s places each of the last s may look at, and how far off they are."""
    behind = np.arange(s)[:, None] + s - np.arange(2 * s)[None, :]
    return behind >= 0, np.clip(behind, 0, 2 * s - 1)


def distances(near: np.ndarray, cfg: LmConfig) -> tuple[np.ndarray, np.ndarray]:
    """The factor of each of 2s places for each of the last s, 0 for later places; and how far off they are."""
    seen, far = causal(cfg.stride)
    return (np.exp(np.clip(near, -30, 30))[far] * seen).astype(np.float32), far


def tables(p: dict, cfg: LmConfig) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket its key, value and a one; and its query and own term."""
    d = cfg.dim
    t = p["e"] @ p["w"]
    own = t[:, 2 * d :].copy()
    own[:, :d] *= np.float32(d**-0.5)
    return np.concatenate([t[:, : 2 * d], np.ones((len(t), 1), np.float32)], axis=1), own


def exp_of(x: np.ndarray) -> None:
    """exp in place, of 60 at most."""
    if x.max(initial=0) > 60:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)


def laid_out(flat: np.ndarray, size: np.ndarray, lead: np.ndarray, bucket: np.ndarray, cfg: LmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of pieces: inputs (last and this stride, as buckets), targets (ids; -1 is none), whether each goes on the one before."""
    s, m = cfg.stride, size - 1
    rows = -(-m // s)
    first = np.cumsum(rows) - rows
    at = spread(m, first * s)
    source = spread(m, np.cumsum(size) - size)
    given = np.full(int(rows.sum()) * s, cfg.buckets, dtype=np.int32)  # buckets: none
    target = np.full(len(given), -1, dtype=np.int32)
    given[at], target[at] = bucket[flat[source]], flat[source + 1]
    given, target = given.reshape(-1, s), target.reshape(-1, s)
    before = np.full_like(given, cfg.buckets)
    before[1:] = given[:-1]
    before[first] = cfg.buckets
    follows, kept = np.ones(len(given), bool), np.ones(len(given), bool)
    follows[first] = False
    follows[first[lead] + 1] = False
    kept[first[lead]] = False
    return np.concatenate([before[kept], given[kept]], axis=1), target[kept], follows[kept]


def gradient(p: dict, ch: Channels, follow: Follow, u: np.ndarray, target: np.ndarray, cfg: LmConfig, follows: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The gradient of the mean log-probability of the targets' classes; the other factors have no weights.

    A window that ``follows`` the one before shares that one's ids as its context, so what both say about
    these ids is added up before it is summed by bucket.
    """
    s, d, n = cfg.stride, cfg.dim, len(u)
    u = u.astype(np.intp)
    last, early = u[:, s:], u[:, :s]
    keyed, asked = tables(p, cfg)
    mask, far = distances(p["near"], cfg)
    k, o = keyed.take(u, axis=0), asked.take(last, axis=0)
    v, k, q = k[..., d:], k[..., :d], o[..., :d]
    w = np.matmul(q, k.transpose(0, 2, 1))
    exp_of(w)
    w *= mask
    w[early[:, 0] == cfg.buckets, :, :s] = 0  # a text's first window has no context; later places without a bucket come after all targets
    a = np.matmul(w, v)
    inverse = 1 / np.maximum(a[..., d:], np.float32(1e-30))
    a = a[..., :d] * inverse
    h = (a + o[..., d:]).reshape(-1, d)
    z = h @ p["u"]
    exp_of(z)
    z *= (follow.prior * np.exp(np.minimum(p["c"], 60))).take(np.minimum(last, cfg.buckets - 1).ravel(), axis=0)
    t = target.ravel()
    on = np.flatnonzero(t >= 0)
    share = np.float32(1 / max(len(on), 1))
    scale = np.zeros(len(t), np.float32)
    scale[on] = -share / np.maximum((z @ np.ones(z.shape[1], np.float32))[on], np.float32(1e-30))
    z *= scale[:, None]
    z.ravel()[on * z.shape[1] + follow.cls[ch.bucket[t[on]]]] += share
    g = {"u": h.T @ z, "c": np.ones(len(z), np.float32) @ z}
    dh = (z @ p["u"].T).reshape(n, s, d)
    dv = np.empty((n, s, d + 1), np.float32)
    np.multiply(dh, inverse, out=dv[..., :d])
    dv[..., d] = -np.einsum("nsd,nsd->ns", dv[..., :d], a)
    dw = np.matmul(dv, v.transpose(0, 2, 1))
    dw *= w
    context = np.concatenate([np.matmul(dw.transpose(0, 2, 1), q), np.matmul(w.transpose(0, 2, 1), dv[..., :d])], axis=2)
    both = np.concatenate([context[:, s:], np.matmul(dw, k) * np.float32(d**-0.5), dh], axis=2)
    context = context[:, :s]
    on_one = np.zeros(n, bool) if follows is None else follows.copy()
    on_one[:1] = False
    again = np.flatnonzero(on_one)
    both[again - 1, :, : 2 * d] += context[again]
    alone = np.flatnonzero(~on_one & (early[:, 0] != cfg.buckets))
    ids, rest = early[alone].ravel(), context[alone].reshape(-1, 2 * d)
    both = both.reshape(-1, 4 * d)
    maps = p["w"]
    g["w"] = p["e"].take(last.ravel(), axis=0).T @ both
    g["w"][:, : 2 * d] += p["e"].take(ids, axis=0).T @ rest
    rows = np.concatenate([both @ maps.T, rest @ maps[:, : 2 * d].T])
    place = (np.concatenate([last.ravel(), ids])[:, None] * d + np.arange(d)).ravel()
    g["e"] = np.bincount(place, rows.ravel(), p["e"].size).reshape(p["e"].shape).astype(np.float32)
    g["near"] = np.bincount(far.ravel(), dw.sum(0).ravel(), 2 * s).astype(np.float32)
    return g


def gradient_graph(follow: Follow, cfg: LmConfig):
    """What ``gradient`` gives, as a session: every term is the same, sums are in another order.

    A place without a bucket has neither value nor weight in the attention, so nothing depends on it.
    What is said about ids is summed by bucket at once, for all places of all windows.
    """
    s, d, c, g = cfg.stride, cfg.dim, cfg.classes, graphs.Graph()
    ints, flat = lambda *x: np.array(x, np.int64), lambda x: g("Reshape", x, np.array([-1, d], np.int64))
    swapped, below = lambda x: g("Transpose", x, perm=[0, 2, 1]), lambda x: g("Exp", g("Clip", x, "", np.float32(60)[...]))
    least = lambda x: g("Clip", x, np.float32(1e-30)[...])
    keep = np.ones((cfg.buckets + 1, 1), np.float32)
    keep[-1] = 0
    u, last, cls = g.input("place", 2, np.int64), g.input("last", 2, np.int64), g.input("cls", 1, np.int64)
    weight, share, mask = g.input("weight", 2), g.input("share", 1), g.input("mask", 2)
    e, maps, top, shift = g.input("e", 2), g.input("w", 2), g.input("u", 2), g.input("c", 1)
    key, value, query, own = g("Split", g("MatMul", e, maps), ints(d, d, d, d), outputs=4, axis=1)
    k, q, o = g("Gather", key, u), g("Gather", g("Mul", query, np.float32(d**-0.5)[...]), last), g("Gather", own, last)
    v = g("Gather", g("Mul", g("Concat", value, np.ones((cfg.buckets + 1, 1), np.float32), axis=1), keep), u)
    w = g("Mul", below(g("MatMul", q, swapped(k))), mask)
    a, total = g("Split", g("MatMul", w, v), ints(d, 1), outputs=2, axis=2)
    inverse = g("Reciprocal", least(total))
    a = g("Mul", a, inverse)
    h = flat(g("Add", a, o))
    prior = g("Mul", np.concatenate([follow.prior, np.ones((1, c), np.float32)]), below(shift))
    z = g("Mul", below(g("MatMul", h, top)), g("Gather", prior, g("Reshape", last, ints(-1))))
    z = g("Mul", z, g("Div", weight, least(g("ReduceSum", z, ints(1), keepdims=1))))
    z = g("Sub", g("Gather", g("Mul", np.eye(c + 1, c, dtype=np.float32), share), cls), z)
    g.output("gu", g("MatMul", g("Transpose", h, perm=[1, 0]), z), 2)
    g.output("gc", g("ReduceSum", z, ints(0), keepdims=0), 1)
    dh = g("Reshape", g("MatMul", z, g("Transpose", top, perm=[1, 0])), ints(-1, s, d))
    dv = g("Mul", dh, inverse)
    less = g("Neg", g("ReduceSum", g("Mul", dv, a), ints(2), keepdims=1))
    dw = g("Mul", g("MatMul", g("Concat", dv, less, axis=2), swapped(v)), w)
    g.output("gnear", g("ReduceSum", dw, ints(0), keepdims=0), 2)
    by = lambda x, at: g("ScatterND", np.zeros((cfg.buckets + 1, d), np.float32), g("Unsqueeze", at, ints(2)), x, reduction="add")
    # the last row, of places without a bucket, can be infinite where a weight has vanished
    of_value = g("Concat", g("Slice", by(g("MatMul", swapped(w), dv), u), ints(0), ints(cfg.buckets), ints(0)), np.zeros((1, d), np.float32), axis=0)
    of_query = g("Mul", by(g("MatMul", dw, k), last), np.float32(d**-0.5)[...])
    every = g("Concat", by(g("MatMul", swapped(dw), q), u), of_value, of_query, by(dh, last), axis=1)
    g.output("gw", g("MatMul", g("Transpose", e, perm=[1, 0]), every), 2)
    g.output("ge", g("MatMul", every, g("Transpose", maps, perm=[1, 0])), 2)
    return g.session()


def graph_gradient(session, p: dict, ch: Channels, follow: Follow, u: np.ndarray, target: np.ndarray, cfg: LmConfig) -> dict[str, np.ndarray]:
    """``gradient`` by the session of ``gradient_graph``."""
    s, u = cfg.stride, u.astype(np.int64)
    mask, far = distances(p["near"], cfg)
    t = target.ravel()
    on = t >= 0
    share = np.float32(1 / max(np.count_nonzero(on), 1))
    cls = np.where(on, follow.cls[ch.bucket[t]], cfg.classes)
    given = {"place": u, "last": np.ascontiguousarray(u[:, s:]), "cls": cls, "weight": (on * share)[:, None], "share": np.array([share]), "mask": mask} | {k: p[k] for k in "ewuc"}
    g = {}
    g["u"], g["c"], near, g["w"], g["e"] = session.run(["gu", "gc", "gnear", "gw", "ge"], given)
    g["near"] = np.bincount(far.ravel(), near.ravel(), 2 * s).astype(np.float32)
    return g


class Climb:
    """Adam steps over windows as they come, ``steps_of`` at a time; what is left over waits for more."""

    def __init__(self, p: dict, ch: Channels, follow: Follow, cfg: LmConfig):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.ch, self.follow, self.cfg = ch, follow, cfg
        self.steps = self.seen = 0
        self.left: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.session = gradient_graph(follow, cfg) if graphs.available() else None

    def add(self, u: np.ndarray, target: np.ndarray, follows: np.ndarray | None = None) -> None:
        self.seen += len(u)
        follows = np.zeros(len(u), bool) if follows is None else follows
        if self.left is not None:
            u, target, follows = (np.concatenate(x) for x in zip(self.left, (u, target, follows), strict=True))
        full = len(u) - len(u) % self.cfg.steps_of
        for a in range(0, full, self.cfg.steps_of):
            self.step(*(x[a : a + self.cfg.steps_of] for x in (u, target, follows)))
        self.left = u[full:], target[full:], follows[full:]

    def end(self) -> dict:
        """The weights, after a last step on what is left."""
        if self.left is not None and len(self.left[0]):
            self.step(*self.left)
            self.left = None
        return self.p

    def gradient(self, u: np.ndarray, target: np.ndarray, follows: np.ndarray) -> dict:
        if self.session is None:
            return gradient(self.p, self.ch, self.follow, u, target, self.cfg, follows)
        return graph_gradient(self.session, self.p, self.ch, self.follow, u, target, self.cfg)

    def step(self, u: np.ndarray, target: np.ndarray, follows: np.ndarray) -> None:
        self.steps += 1
        one, two = self.cfg.rate / (1 - 0.9**self.steps), 1 / (1 - 0.99**self.steps)
        for k, x in self.gradient(u, target, follows).items():
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (x - m)
            x *= x
            v += np.float32(0.01) * (x - v)
            root = np.sqrt(v * np.float32(two))
            root += np.float32(1e-8)
            np.divide(m, root, out=root)
            root *= np.float32(one)
            self.p[k] += root


def pair_counts(seen: DataFrame, shared, cfg: LmConfig) -> DataFrame:
    """key, n: how often a bucket follows a bucket (last * buckets + next), over all pieces."""

    def run(batches):
        ch = shared.value
        pairs, waiting = np.zeros(cfg.buckets * cfg.buckets, dtype=np.int64), []
        for batch in batches:
            for x in batch.column(0):
                flat, size, lead = unpacked(x.as_buffer())
                m = size - 1 - cfg.stride * lead  # without the context that leads
                at = spread(m, np.cumsum(size) - m - 1)
                waiting.append(ch.bucket[flat[at]] * np.int64(cfg.buckets) + ch.bucket[flat[at + 1]])
                if len(waiting) == 16:
                    pairs += np.bincount(np.concatenate(waiting), minlength=len(pairs))
                    waiting = []
        if waiting:
            pairs += np.bincount(np.concatenate(waiting), minlength=len(pairs))
        keys = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pairs[keys])], ["key", "n"])

    return seen.select("w").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def averaged(seen: DataFrame, shared, weights: dict, cfg: LmConfig) -> dict:
    """Every task climbs on its windows of ``seen``; the weights are averaged by how many windows each saw."""
    names = list(weights)
    sent = seen.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        ch, follow = shared.value
        task = Climb(sent.value, ch, follow, cfg)
        for b in batches:
            for x in b.column(0):
                task.add(*laid_out(*unpacked(x.as_buffer()), ch.bucket, cfg))
        if task.seen:
            p = task.end()
            flat = np.concatenate([p[k].ravel() for k in names]).astype(np.float64) * task.seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), task.seen))], ["i", "x", "n"])

    got = seen.select("w").mapInArrow(run, "i long, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
    if not got.num_rows:
        return weights
    flat = np.zeros(got.num_rows, np.float32)
    flat[np.asarray(got.column("i"))] = np.asarray(got.column("x"))
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + weights[k].size].reshape(weights[k].shape)
        at += weights[k].size
    return out


@dataclass
class Model:
    """All that scoring needs. ``words`` and ``counts``: the frequent words' hashes, sorted, and counts."""

    channels: Channels
    follow: Follow
    weights: dict
    words: np.ndarray
    counts: np.ndarray
    n: int
    v: int


def train(docs: DataFrame, cfg: LmConfig) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words (key, n)."""
    sc = docs.sparkSession.sparkContext
    seen = cut(gathered(docs, cfg), "gathered")
    sums = cut(seen.filter("kind < 2").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words_ = sums.filter("kind = 0").select("key", "n")
    n, v = words_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = words_.filter(F.col("n") * cfg.frequent >= n).toArrow()  # at most ``frequent`` words have so many of N
    key, c = np.asarray(often.column("key")).view(np.uint64), np.asarray(often.column("n"))
    order = np.argsort(key)
    got = sums.filter("kind = 1").select("key", "n").toArrow()  # one row for each id of the tokenizer at most
    ids = np.zeros(subwords(cfg).n, dtype=np.float64)
    ids[np.asarray(got.column("key"))] = np.asarray(got.column("n"))
    channels = Channels(ids, cfg)
    got = pair_counts(seen.filter("kind = 3"), sc.broadcast(channels), cfg).toArrow()  # buckets squared at most
    pairs = np.zeros(cfg.buckets * cfg.buckets)
    pairs[np.asarray(got.column("key"))] = np.asarray(got.column("n"))
    follow = Follow(pairs.reshape(cfg.buckets, cfg.buckets), channels.unigram, cfg)
    shared, weights = sc.broadcast((channels, follow)), start_weights(cfg)
    for part in range(len(cfg.parts)):
        weights = averaged(seen.filter(f"kind = 3 and key = {part}"), shared, weights, cfg)
    return Model(channels, follow, weights, key[order], c[order], int(n), int(v)), words_


class Scorer:
    """The trained model laid out for scoring.

    The causal mask and the term for distance are one matrix of factors; a last column of the keys makes
    the weight of places without a bucket vanish, one of the values adds the weights up; and whatever
    depends on the last bucket alone is one table of class probabilities.
    """

    def __init__(self, m: Model, cfg: LmConfig):
        p, d = m.weights, cfg.dim
        self.m, self.cfg = m, cfg
        keyed, asked = tables(p, cfg)
        gone = np.zeros((cfg.buckets + 1, 1), np.float32)
        gone[-1] = -1e4
        self.keyed = np.concatenate([keyed[:, :d], gone, keyed[:, d:]], axis=1)
        self.queries = np.concatenate([asked[:, :d], np.ones((cfg.buckets + 1, 1), np.float32)], axis=1)
        self.mask, _ = distances(p["near"], cfg)
        own = asked[:-1, d:] @ p["u"] + p["c"]
        self.prior = m.follow.prior * np.exp(own - own.max(axis=1, keepdims=True))
        self.within = m.follow.within.ravel()
        self.cls = m.follow.cls[m.channels.bucket].astype(np.int64)  # of ids
        self.ones = np.ones(cfg.classes, np.float32)
        self.session = self.graph() if graphs.available() else None

    def graph(self):
        """The probability of every target's class, from its window's buckets, as a session."""
        d, g, top = self.cfg.dim, graphs.Graph(), self.m.weights["u"]
        ints, longest = lambda *x: np.array(x, np.int64), lambda x, axis: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis).max()))
        # products are no larger than those of the longest rows, and means of values no longer than these
        exp = lambda x, most: g("Exp", x if most < 59 else g("Clip", x, "", np.float32(60)[...]))
        u, last, cls = g.input("place", 2, np.int64), g.input("last", 2, np.int64), g.input("cls", 2, np.int64)
        q, k = g("Gather", self.queries, last), g("Gather", self.keyed[:, : d + 1], u)
        w = exp(g("MatMul", q, g("Transpose", k, perm=[0, 2, 1])), longest(self.queries[:, :d], 1) * longest(self.keyed[:, :d], 1))
        w = g("Mul", w, self.mask)
        total = g("Clip", g("ReduceSum", w, ints(2), keepdims=1), np.float32(1e-30)[...])
        h = g("MatMul", w, g("Gather", self.keyed[:, d + 1 : 2 * d + 1], u))
        h = g("Reshape", g("Mul", h, g("Reciprocal", total)), ints(-1, d))
        prior = np.concatenate([self.prior, np.ones((1, self.cfg.classes), np.float32)])
        z = exp(g("MatMul", h, top), longest(self.keyed[:, d + 1 : 2 * d + 1], 1) * longest(top, 0))
        z = g("Mul", z, g("Gather", prior, g("Reshape", last, ints(-1))))
        g.output("x", g("Div", g("GatherElements", z, cls, axis=1), g("ReduceSum", z, ints(1), keepdims=1)), 2)
        return g.session()

    def logs(self, u: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of every target, and their flat places."""
        ch = self.m.channels
        u = u.astype(np.int64)
        last, on = u[:, self.cfg.stride :], np.flatnonzero(target.ravel() >= 0)
        t, before = target.ravel()[on], last.ravel()[on]
        if self.session is None:
            x = self.of_classes(u, last, on, t, before)
        else:
            given = {"place": u, "last": np.ascontiguousarray(last), "cls": self.cls[np.maximum(target, 0)].reshape(-1, 1)}
            x = self.session.run(["x"], given)[0].ravel()[on]
        x *= self.within.take(before * self.cfg.buckets + ch.bucket[t])
        x *= ch.in_bucket[t]
        return np.log10(np.maximum(x, 1e-30)), on

    def of_classes(self, u: np.ndarray, last: np.ndarray, on: np.ndarray, t: np.ndarray, before: np.ndarray) -> np.ndarray:
        """What ``graph`` gives, for the places ``on``, where that can't be run."""
        d = self.cfg.dim
        k = self.keyed.take(u, axis=0)
        w = np.matmul(self.queries.take(last, axis=0), k[..., : d + 1].transpose(0, 2, 1))
        exp_of(w)
        w *= self.mask
        h = np.matmul(w, k[..., d + 1 :])
        h = h[..., :d] / np.maximum(h[..., d:], np.float32(1e-30))
        z = h.reshape(-1, d).take(on, axis=0) @ self.m.weights["u"]
        exp_of(z)
        z *= self.prior.take(before, axis=0)
        return z.ravel()[np.arange(len(on)) * z.shape[1] + self.cls[t]] / (z @ self.ones)

    def texts(self, flat: np.ndarray, n: np.ndarray, end: int, batch: int = 256) -> np.ndarray:
        """log10 of each text's probability."""
        u, target, text = chunks(flat, n, self.m.channels.bucket, end, self.cfg)
        out = np.zeros(len(n))
        for a in range(0, len(u), batch):
            p, on = self.logs(u[a : a + batch], target[a : a + batch])
            out += np.bincount(text[a : a + batch][on // self.cfg.stride], p, len(n))
        return out


def scored(docs: DataFrame, cfg: LmConfig = LmConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    model, counts = train(docs, cfg)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, code, done = shared.value, subwords(cfg), 0
        scorer = Scorer(m, cfg)
        row = TaskContext.get().partitionId() << 40
        value = np.log10((m.counts + 1.0) / (m.n + m.v + 1))
        end_at = int(np.searchsorted(m.words, END))
        end_known = end_at < len(m.words) and m.words[end_at] == END
        for b in batches:
            for i, j, data, off in hashing.blocks(b.column(1)):
                w = hashing.words(data, off)
                unique, where, back, _ = distinct(w.hash)
                at = np.minimum(np.searchsorted(m.words, unique), max(len(m.words) - 1, 0))
                often = m.words[at] == unique if len(m.words) else np.zeros(len(unique), bool)
                each = np.where(often, value[at] if len(value) else 0.0, 0.0)[back]
                rare = ~often[back]
                size = np.diff(w.first)
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])  # noqa: E731, B023
                flat, n = code.ids(w, data, unique, where, back)
                offsets = np.concatenate([[0], np.cumsum(sums(rare))])
                left = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(w.hash[rare].view(np.int64)))
                if end_known:
                    base, known = sums(each) + value[end_at], sums(~rare) + 1
                else:  # the end is a rare word then
                    base, known = sums(each), sums(~rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + done + np.arange(j - i)), b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(size + 1), pa.array(known.astype(np.int64)),
                        pa.array(base), pa.array(scorer.texts(flat, n, code.end)), left, pa.array(np.full(j - i, not end_known)),
                    ],
                    ["row", "doc_id", "n_tokens", "known", "base", "score", "rare", "end_rare"],
                )
                done += j - i

    most = cut(docs.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, score double, rare array<long>, end_rare boolean"), "scored")
    rare = most.select("row", F.explode(F.when(F.col("end_rare"), F.concat("rare", F.array(F.lit(int(END)).cast("long")))).otherwise(F.col("rare"))).alias("key"))
    c = F.coalesce(F.col("n"), F.lit(0))
    few = rare.join(counts, "key", "left").groupBy("row").agg(F.sum(F.log10((c + 1.0) / (model.n + model.v + 1))).alias("more"), F.count_if(c > 0).alias("also"))
    zero = F.lit(0.0) if model.n == 0 else None
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) if zero is None else zero
    return most.drop("rare").join(few, "row", "left").select(
        "doc_id", held_out(cfg).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
