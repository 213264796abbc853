"""WARC archives: written with revisit records, read back by verified chains of record boundaries."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, stash
from .files import Replaced, filesystem

MAGIC = b"WARC/1.1\r\n"
#: What records of either version begin with, and the part of it that is looked for.
VERSIONS, SOUGHT = (b"WARC/1.0\r\n", MAGIC), b"WARC/1."
#: A gzip member with an extra field "sl", which holds its lengths, compressed and not; other writers' members have none.
MEMBER = struct.Struct("<4s6sH4sII")
GZIP, EXTRA = b"\x1f\x8b\x08\x04", b"sl\x08\x00"
ANY_GZIP = GZIP[:3]
END = b"\r\n\r\n"
HEAD = re.compile(rb"(?:[A-Za-z0-9-]+:[^\r\n]*\r\n)+\r\n")
FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")
#: A record's header, with the URL in it, is read in steps of so many bytes.
STEP = 1 << 16
#: Stands for a null page_id in joins.
NO_ID = -(2**63)


def revisits(dealt: DataFrame, pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds record_type and refers_to to `pages` (page_id, url, payload, digest; digest as lower-case hex).

    `dealt` are the same rows, partitioned by __k (page_id, or NO_ID) and digest,
    which is how the result is partitioned, too.

    Of rows with equal payloads of `least_bytes` at least, those with the
    largest page_id are responses and the others revisit it. Rows whose page_id
    is null revisit, too, unless all are null. Only digests that occur more than
    once are joined, and counted before they are shuffled.
    """
    long = F.octet_length("payload") >= least_bytes
    seen = pages.where(long).groupBy(F.col("digest").alias("__d")).agg(F.max("page_id").alias("__to"), F.count("*").alias("__n"))
    rows = pages.select("page_id", "digest", long.alias("__long")).where("__long").distinct()
    again = rows.join(seen.where("__n > 1"), F.col("digest") == F.col("__d")).where(~F.col("page_id").eqNullSafe(F.col("__to")))
    again = again.select(F.col("page_id").alias("__p"), F.col("digest").alias("__pd"), "__to")
    again = again.select(F.coalesce("__p", F.lit(NO_ID)).alias("__k"), F.col("__pd").alias("digest"), F.lit(True).alias("__again"), "__to")
    joined = dealt.join(again, ["__k", "digest"], "left")
    return joined.select(
        *pages.columns,
        F.when(F.col("__again").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("__to").alias("refers_to"),
    )


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member with its lengths in its header."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data))
    return MEMBER.pack(GZIP, b"\0\0\0\0\0\xff", 12, EXTRA, MEMBER.size + len(body), len(data)) + body


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~"))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def write_warc(pages: DataFrame, folder: str, pages_per_file: int = 2048, least_bytes: int = 1000, compressed: bool = True) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html; other columns are ignored) to files in `folder`.

    The payload is the html in UTF-8, empty for null. Rows are dealt to files by
    page_id and payload, in the one shuffle of payloads, and a file keeps them
    in that order. Compressed, each record is a gzip member of its own. Returns
    the table of files (path, size), also written to `folder`/files.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    n = max(-(-pages.count() // pages_per_file), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches):
        out = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "refers_to", "record_type")]
            for *row, kind in zip(*columns):
                if out is None:
                    uri = f"{folder}/pages-{TaskContext.get().partitionId():08d}.warc{'.gz' * compressed}"
                    out = Replaced(uri)
                data = record(*row, kind == "revisit")
                out.write(member(data) if compressed else data)
        if out:
            size = out.out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size])], ["path", "size"])

    dealt = pages.withColumn("__k", F.coalesce("page_id", F.lit(NO_ID))).repartition(n, "__k", "digest")
    rows = revisits(dealt, pages, least_bytes)
    files = rows.sortWithinPartitions("page_id", "digest").mapInArrow(write, "path string, size long")
    files.write.parquet(f"{folder}/files")
    return spark.read.schema(files.schema).parquet(f"{folder}/files")


class Block:
    """The bytes of a file from `start` to `end`, and as many after it as a record that begins in it takes."""

    def __init__(self, path: str, start: int, end: int):
        fs, where = filesystem(path)
        self.file, self.start, self.end = fs.open_input_file(where), start, end
        self.data = self.file.read_at(end - start, start)
        self.compressed = path.endswith(".gz")
        self.magic = ANY_GZIP if self.compressed else SOUGHT

    def read(self, at: int, stop: int) -> bytes:
        have = self.start + len(self.data)
        if stop > have:
            self.data += self.file.read_at(stop - have, have)
        return self.data[at - self.start : stop - self.start]

    def header(self, at: int) -> tuple[dict[bytes, bytes], int] | None:
        """An uncompressed record's fields and where its block begins, if there is a well-formed header at `at`."""
        size = STEP
        while True:
            data = self.read(at, at + size)
            if not data.startswith(VERSIONS):
                return None
            if m := HEAD.match(data, len(MAGIC)):
                fields = {k.lower(): v for k, v in FIELD.findall(m[0])}
                return (fields, at + m.end()) if fields.get(b"content-length", b"").isdigit() else None
            if len(data) < size or END in data:
                return None
            size *= 2

    def successor(self, at: int) -> int | None:
        """Where the record that begins at `at` says that the next one does; nothing if none can begin there."""
        if not self.compressed:
            found = self.header(at)
            return found and found[1] + int(found[0][b"content-length"]) + len(END)
        head = self.read(at, at + MEMBER.size)
        if len(head) == MEMBER.size:
            magic, _, extra_size, extra, size, _ = MEMBER.unpack(head)
            if (magic, extra_size, extra) == (GZIP, 12, EXTRA):
                return at + size if size > MEMBER.size else None
        return self.inflated(at)

    def inflated(self, at: int) -> int | None:
        """Where the gzip member at `at` ends, found by inflating it; nothing unless it holds a record. Keeps no more than a step of it."""
        out, first, begin = zlib.decompressobj(31), b"", at
        try:
            while not out.eof:
                data = out.unconsumed_tail or self.read(at, at + STEP)
                if not data:
                    return None  # the file ends in it
                at += 0 if out.unconsumed_tail else len(data)
                part = out.decompress(data, STEP)
                if len(first) < len(MAGIC):
                    first += part[: len(MAGIC)]
                    if not any(v.startswith(first[: len(v)]) for v in VERSIONS):
                        return None
        except zlib.error:
            return None
        to = at - len(out.unused_data)
        return to if first.startswith(VERSIONS) and to > begin else None

    def record(self, at: int) -> tuple[dict[bytes, bytes], bytes, int] | None:
        """The fields and the block of the record at `at`, and where the next one begins."""
        to = self.successor(at)
        if to is None:
            return None
        if self.compressed:
            data = zlib.decompress(self.read(at, to), 31)
            m = HEAD.match(data, len(MAGIC))
            return {k.lower(): v for k, v in FIELD.findall(m[0])}, data[m.end() : -len(END)], to
        fields, begin = self.header(at)
        return fields, self.read(begin, to - len(END)), to

    def candidates(self) -> Iterator[int]:
        """Every place in the block where a record might begin."""
        data = self.read(self.start, self.end + len(self.magic) - 1)
        at = data.find(self.magic)
        while at >= 0:
            yield self.start + at
            at = data.find(self.magic, at + 1)


def _exits(block: Block) -> dict[int, int]:
    """For each candidate of the block, the offset at or after its end to which its chain of successors leads.

    A chain that leads to a place in the block that is no candidate is broken: no record begins there.
    """
    after = {at: to for at in block.candidates() if (to := block.successor(at)) is not None}
    out: dict[int, int | None] = {}
    for at in sorted(after, reverse=True):  # successors lie further on
        to = after[at]
        out[at] = to if to >= block.end else out.get(to)
    return {at: to for at, to in out.items() if to is not None}


def read_warc(files: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """The records of `files` (path, size) that are reachable from the files' starts.

    Each task searches a block for all that look like a record's header, in
    payloads too, and emits where the chain of successors from there leaves the
    block. From the start of each file, pointer jumping over these offsets finds
    where the true chain enters each block; from there the records are read. A
    file whose chain does not lead to its end is refused (ValueError, with the
    last place that it leads to). Files of no bytes have no records. Members of a
    .gz file tell their lengths, or else are inflated to find their ends; records
    of other writers and of any type are read, with a null page_id. Returns
    page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload
    (null for revisits; of records that hold no HTTP message, the whole block).
    """
    blocks = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(block_bytes))).alias("start"))
    blocks = blocks.where("size > 0").select("path", "start", F.least(F.col("start") + block_bytes, F.col("size")).alias("end"))
    spread = lambda df: df.repartition(max(1, min(df.count(), 10_000)))  # noqa: E731  one block a task, about

    def search(batches):
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                exits = _exits(Block(path, start, end))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(exits), pa.string()), pa.array(list(exits), pa.int64()), pa.array(list(exits.values()), pa.int64())],
                    ["path", "at", "to"],
                )

    jumps = stash(spread(blocks).mapInArrow(search, "path string, at long, to long"), "warc-jumps")
    entries = jumps.select("path", F.col("to").alias("at")).union(files.select("path", F.lit(0).cast("long"))).distinct()
    jumps = stash(jumps.join(entries, ["path", "at"], "left_semi"), "warc-jumps")  # one for each block, about
    reached = stash(files.select("path", F.lit(0).cast("long").alias("at")), "warc-reached")
    known = reached.count()
    while True:
        step = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = stash(reached.union(step).distinct(), "warc-reached")
        if (n := reached.count()) == known:
            break
        known = n
        twice = jumps.alias("a").join(jumps.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.to") == F.col("b.at")))
        jumps = stash(twice.select("a.path", "a.at", "b.to"), "warc-jumps")

    ends = reached.groupBy("path").agg(F.max("at").alias("at")).join(files.select("path", "size"), "path").where("size > 0 and at <> size")
    if broken := ends.orderBy("path").first():
        raise ValueError(f"{broken['path']}: no record leads on from the block at {broken['at']}; the file has {broken['size']} bytes")

    def read(batches):
        for batch in batches:
            for path, end, at in zip(*(batch.column(k).to_pylist() for k in ("path", "end", "at"))):
                rows, size = [], 0
                for row in _records(Block(path, at, end), at):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    entered = reached.withColumn("start", F.col("at") - F.col("at") % block_bytes)
    found = blocks.join(entered, ["path", "start"]).where("at < end").select("path", "end", "at")
    return spread(found).mapInArrow(read, COLUMNS)


COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _records(block: Block, at: int) -> Iterator[dict]:
    number = lambda v: int(m[1]) if v and (m := re.match(rb"<urn:page:(-?\d+)>", v)) else None
    while at < block.end and (found := block.record(at)):
        fields, data, at = found
        kind = fields.get(b"warc-type", b"").decode()
        revisit = kind == "revisit"
        # Only records of HTTP messages have a payload apart from their block.
        http, _, payload = data.partition(END) if revisit or fields.get(b"content-type", b"").startswith(b"application/http") else (b"", b"", data)
        length = re.search(rb"(?i)content-length: *(\d+)", http)
        said = fields.get(b"warc-payload-digest", b"").decode()
        digest = _sha1(said) if said else None if revisit else hashlib.sha1(payload).hexdigest()
        if said.lower().startswith("sha1:") and not revisit and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"a payload differs from its digest {said}")
        yield {
            "page_id": number(fields.get(b"warc-record-id")),
            "url": fields[b"warc-target-uri"].decode() if b"warc-target-uri" in fields else None,
            "payload_bytes": int(length[1]) if length else len(payload),
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": number(fields.get(b"warc-refers-to")),
            "payload": None if revisit else payload,
        }


def _sha1(said: str) -> str:
    """A digest as lower-case hex; other writers have it in base 32."""
    name, _, value = said.partition(":")
    if name.lower() == "sha1" and len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() if name.lower() == "sha1" else said


def archived(pages: DataFrame) -> DataFrame:
    """Writes `pages` to WARC files in a new folder beside the checkpoints, and reads them back."""
    return read_warc(write_warc(pages, new_folder(pages.sparkSession, "warc")))


#: op9 in DuckDB SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m USING (h)
"""
