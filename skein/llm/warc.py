"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: each task gathers records into archives of bounded size, trains a dictionary on each archive's
first payloads and writes it ahead in a skippable frame (magic 0x184D2A5D). Reading: the dictionary is
loaded from that frame, records are decoded one frame at a time, and version line, required headers,
lengths and digests are validated; what fails is reported with its offset, never skipped in silence.
An archive is a row (name, content), so it goes through any store that Spark can write; ``read_archives``
also takes the rows of Spark's ``binaryFile`` source.

Of records with equal payloads of at least ``revisit_bytes`` bytes, those with the largest page_id are
responses and the others revisit it. A null payload is empty; a null url becomes an empty one, and its
line breaks are percent-encoded. Rows that repeat a page_id are records of their own. Only the three
named columns are read; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, table

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


@dataclass(frozen=True)
class WarcConfig:
    revisit_bytes: int = 1000
    archive_bytes: int = 8 << 20  # of records, before compression
    dictionary_bytes: int = 32 << 10
    sample_bytes: int = 1 << 20  # of payloads that an archive's dictionary is trained on
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that isn't what the format asks for."""


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record. A revisit has its response's headers but no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; WarcError if its version, headers, lengths or digest are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] != VERSION.decode():
        raise WarcError("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"a header without a colon: {line[:40]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise WarcError(f"no {name}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("the block isn't as long as Content-Length says")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    size = int(sizes[0]) if sizes else len(payload)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    name_of = lambda v: int(v) if (v := v.strip("<>").removeprefix(URN)) else None
    if kind == "revisit":
        if "warc-refers-to" not in fields or payload:
            raise WarcError("a revisit needs what it refers to and no payload")
        refers = name_of(fields["warc-refers-to"])
    elif kind == "response":
        if size != len(payload):
            raise WarcError("the payload isn't as long as the HTTP header says")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("the payload's digest differs")
        refers = None
    else:
        raise WarcError(f"a record of type {kind}")
    return {"page_id": name_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": refers, "payload": payload if kind == "response" else None}


def archive(records: list[bytes], samples: list[bytes], cfg: WarcConfig) -> bytes:
    """The bytes of an archive file."""
    import zstandard

    out, dictionary = [], None
    if len(samples) >= 8:
        try:
            dictionary = zstandard.train_dictionary(min(cfg.dictionary_bytes, max(1024, sum(map(len, samples)) // 8)), samples)
        except zstandard.ZstdError:  # samples too small or too alike for one
            dictionary = None
    if dictionary is not None:
        raw = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    press = zstandard.ZstdCompressor(level=cfg.level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def records_of(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame, decoded one at a time with the dictionary that leads the file."""
    import zstandard

    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        if len(raw) != size:
            raise WarcError("the dictionary's frame is cut short")
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        end = frame_end(content, at)
        one = reader.decompressobj()
        try:
            raw = one.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"at {at}: {e}") from e
        if not one.eof or one.unused_data:
            raise WarcError(f"at {at}: a frame that isn't as long as its blocks")
        yield at, raw
        at = end


def frame_end(content: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from the headers of the frame and of its blocks alone."""
    try:
        magic, flags = struct.unpack_from("<IB", content, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            raise WarcError(f"at {at}: a skippable frame among the records")
        if magic != FRAME:
            raise WarcError(f"at {at}: no frame")
        single = flags >> 5 & 1
        p = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        while True:
            head = int.from_bytes(content[p : p + 3], "little")
            if len(content) < p + 3:
                raise struct.error
            p += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # a run of one byte is one byte long
            if head & 1:
                break
        p += 4 * (flags >> 2 & 1)
    except struct.error as e:
        raise WarcError(f"at {at}: a frame is cut short") from e
    if p > len(content):
        raise WarcError(f"at {at}: a frame is cut short")
    return p


ARCHIVE = "name string, content binary"
RECORD = "name string, at long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
_RECORD = pa.schema([("name", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def planned(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """page_id, url, html, refers_to: which records revisit which. Only slim rows meet by digest."""
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = full.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("digest"), F.octet_length("html").alias("size")).filter(F.col("size") >= cfg.revisit_bytes)
    last = keys.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    refers = keys.join(last, ["digest", "size"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    return full.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).join(refers, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """ARCHIVE rows that hold a record for every row of ``pages``."""
    ship(pages.sparkSession)

    def run(batches):
        part, count, size, held, samples, sampled = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{count:06d}.warc.zst"]), pa.array([archive(held, samples, cfg)], pa.binary())], ["name", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, refers = (batch.column(c)[k].as_py() for c in range(4))
                payload = html.encode()
                held.append(record(page_id, url, payload, refers, cfg.date))
                size += len(held[-1])
                if sampled < cfg.sample_bytes and refers is None:
                    samples.append(held[-1][: cfg.sample_bytes // 8])
                    sampled += len(samples[-1])
                if size >= cfg.archive_bytes:
                    yield done()
                    count, size, held, samples, sampled = count + 1, 0, [], [], 0
        if held:
            yield done()

    return planned(pages, cfg).mapInArrow(run, ARCHIVE)


def read_archives(archives: DataFrame) -> DataFrame:
    """RECORD rows of every archive (its first column named name or path, and content)."""
    ship(archives.sparkSession)
    name = "path" if "path" in archives.columns else "name"

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                label, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for r in rows_in(label, content):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return archives.select(name, "content").mapInArrow(run, RECORD)


def rows_in(label: str, content: bytes | None) -> Iterator[dict]:
    """A row for each record; one that is invalid, or the rest of a broken file, is a row with ``error``."""
    at = 0
    try:
        for at, raw in records_of(content or b""):
            try:
                yield {"name": label, "at": at, "error": None} | parse(raw)
            except (WarcError, ValueError) as e:
                yield dict.fromkeys(_RECORD.names) | {"name": label, "at": at, "error": str(e)}
    except WarcError as e:
        yield dict.fromkeys(_RECORD.names) | {"name": label, "at": at, "error": str(e)}


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(write_archives(table(spark, sf_dir, "pages")), "warc")
    read = read_archives(archives)
    sound = F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("archive "), "name", F.lit(": "), "error")).cast("long"))
    return read.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for the rows of op9.
SQL = """with p as (select page_id, coalesce(html, '') as h from pages), k as (select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest from p),
 m as (select payload_digest, payload_bytes, max(page_id) as last from k where payload_bytes >= 1000 group by 1, 2)
 select k.page_id, k.payload_bytes, k.payload_digest, case when k.page_id <> last then 'revisit' else 'response' end as record_type, case when k.page_id <> last then last end as refers_to
 from k left join m using (payload_digest, payload_bytes)"""
