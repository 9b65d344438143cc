"""Packing as vector bin packing: tokens, segments and loss-bearing tokens have limits at the same time.

Every task packs its own documents, in their order, so nothing is shuffled and a lost task makes the
same sequences again. Whole sequences are cut from documents of ``size`` tokens or more; what remains
waits in a pool of bounded length. A sequence takes, again and again, the waiting example that fits and
whose demands have the largest dot product with what the sequence has left, each divided by its limit.
When none fits, the next example is cut to fill the sequence (``cut_to_fill``), and a task's last
tokens are cut into sequences at powers of two, which need no padding. Plain documents bear loss on all
tokens but the first, so the limit on loss counts only where it is below the size; turns of instruction
data say which of them bear loss.

A null text is empty: its document is the end token alone. Repeated rows are packed each. Only the two
named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .hashing import SPACED

_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}
#: Letters of a text without a break, over which the byte-pair merge of the fast library is too slow.
LONG_RUN = 2000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class PackConfig:
    size: int = 1024
    segments: int = 64
    loss: int = 1024
    end_id: int = 0
    pool: int = 512
    cut_to_fill: bool = True
    tokenizer: str | None = None  # a file of the tokenizers library; None: the public byte_bpe_50k


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them, without added special tokens.

    Where a ranks file of the same vocabulary lies beside ``path``, it does the same work faster; texts
    with a special token's string or with very long runs of letters take the library itself.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    held: list = []

    def slow(s: str) -> np.ndarray:
        if not held:  # loaded when first needed: it takes a hundred megabytes
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return np.array(held[0].encode(s, add_special_tokens=False).ids, dtype=np.uint32)

    ranks = f"{path.removesuffix('.json')}.tiktoken"
    if not os.path.exists(ranks):
        _ENCODERS[path] = slow
        return slow
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def fast(s: str) -> np.ndarray:
        if any(t in s for t in special) or len(s) > LONG_RUN and longest_run(s) > LONG_RUN:
            return slow(s)
        return np.asarray(quick.encode_to_numpy(s, disallowed_special=()), dtype=np.uint32)

    _ENCODERS[path] = fast
    return fast


def longest_run(s: str) -> int:
    """Bytes of the longest stretch of a text with only, or without any, ASCII white space."""
    space = ~SPACED[np.frombuffer(s.encode(), dtype=np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return int(np.diff(edges, prepend=-1, append=len(space) - 1).max())


class Packer:
    """Packs examples into sequences; ``pieces`` holds (doc, start, ids, doc tokens, sequence, offset, mask)."""

    def __init__(self, cfg: PackConfig, first_sequence: int):
        self.cfg, self.sequence = cfg, first_sequence
        self.limit = np.array([cfg.size, cfg.segments, cfg.loss], dtype=np.float64)
        self.demand = np.zeros((cfg.pool + 1, 3))
        self.waiting: list[tuple] = []  # doc, start, ids, doc tokens, which tokens bear loss
        self.pieces: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        """One document. ``mask`` tells which tokens bear loss; without it all do but the first, which has nothing before it."""
        if mask is None:
            mask = np.ones(len(ids), dtype=bool)
            mask[0] = False
        n, at, upto = len(ids), 0, np.concatenate([[0], np.cumsum(mask)])
        while at < n:
            to = min(at + self.cfg.size, int(np.searchsorted(upto, upto[at] + self.cfg.loss, side="right")) - 1)
            piece = (doc, at, ids[at:to], n, mask[at:to])
            if to < n or to - at == self.cfg.size:
                self.close([piece])
            else:
                self.wait(piece)
                while len(self.waiting) > self.cfg.pool:
                    self.fill()
            at = to

    def wait(self, piece: tuple) -> None:
        self.demand[len(self.waiting)] = (len(piece[2]), 1, np.count_nonzero(piece[4]))
        self.waiting.append(piece)

    def close(self, taken: list[tuple]) -> None:
        at = 0
        for doc, start, ids, n, mask in taken:
            self.pieces.append((doc, start, ids, n, self.sequence, at, mask))
            at += len(ids)
        self.sequence += 1

    def take(self, k: int) -> tuple:
        piece = self.waiting[k]
        last = self.waiting.pop()
        if k < len(self.waiting):
            self.waiting[k] = last
            self.demand[k] = self.demand[len(self.waiting)]
        return piece

    def fill(self, size: int | None = None) -> None:
        """Make one sequence from the waiting examples."""
        left = self.limit.copy()
        left[0] = size or self.cfg.size
        taken: list[tuple] = []
        while self.waiting and left.min() >= 1:
            need = self.demand[: len(self.waiting)]
            score = np.where((need <= left).all(axis=1), need @ (left / self.limit**2), -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                if not self.cfg.cut_to_fill:
                    break
                k = int(need[:, 0].argmax())  # what is longest is cut anyway
                doc, start, ids, n, mask = self.take(k)
                room = int(min(left[0], np.searchsorted(np.cumsum(mask), left[2], side="right")))
                taken.append((doc, start, ids[:room], n, mask[:room]))
                self.wait((doc, start + room, ids[room:], n, mask[room:]))
                break
            left -= need[k]
            taken.append(self.take(k))
        self.close(taken)

    def finish(self) -> None:
        while self.waiting:
            total = int(self.demand[: len(self.waiting), 0].sum())
            if total >= self.cfg.size or not self.cfg.cut_to_fill:
                self.fill()
            else:
                self.fill(1 << (total.bit_length() - 1))


PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_MASK = pa.field("loss", pa.binary())


def pack(docs: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """PIECES of every row of ``docs`` (doc_id, text); ids are little-endian 32-bit.

    Instruction data has a column ``turns``, array<struct<text string, loss boolean>>, in place of text:
    each turn is encoded alone, bears loss or not, and the end token is of the last one. Its pieces have
    one column more, ``loss``: a byte for each id, 1 where it bears loss.
    """
    ship(docs.sparkSession)
    path = cfg.tokenizer or default_tokenizer()
    turns = "turns" in docs.columns
    schema = _ARROW.append(_MASK) if turns else _ARROW

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
        cols[2] = [ids.astype("<u4").tobytes() for ids in cols[2]]
        if turns:
            cols[6] = [mask.astype("u1").tobytes() for mask in cols[6]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(cfg, TaskContext.get().partitionId() << 40)
        end = np.array([cfg.end_id], dtype=np.uint32)
        for batch in batches:
            ids = batch.column(0)
            for k in range(batch.num_rows):
                value = batch.column(1)[k].as_py()
                if turns:
                    parts = [(encode(t["text"] or ""), bool(t["loss"])) for t in value or () if t]
                    parts.append((end, parts[-1][1] if parts else False))
                    mask = np.concatenate([np.full(len(p), on) for p, on in parts])
                    mask[0] = False
                    packer.add(ids[k].as_py(), np.concatenate([p for p, _ in parts]), mask)
                else:
                    packer.add(ids[k].as_py(), np.concatenate([encode(value or ""), end]))
                if len(packer.pieces) >= 2048:
                    yield batch_of(packer.pieces)
                    packer.pieces = []
        packer.finish()
        yield batch_of(packer.pieces)

    return docs.select("doc_id", "turns" if turns else "text").mapInArrow(run, PIECES + ", loss binary" * turns)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    """The columns of the query: lengths and a checksum for the ids."""
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
