"""WARC archives with a two-level capture index.

``write_archive`` writes one gzip member per record into WARC/1.1 files, one file per
task and ``ROTATE`` bytes.  Of records with equal payloads of at least ``LEAST_REVISIT``
bytes the one with the smallest id is a response and the others are revisits.  Captures
are sorted by reversed-host URL key and id, cut into blocks of lines, and each block is
compressed on its own (first level).  The directory (second level) holds the first key of
each block with its place; blocks grow with the archive so that the directory keeps to
about ``DIRECTORY`` entries, and it is broadcast.  ``lookup`` finds the blocks of wanted
captures by binary search, reads each block once as a byte range, and ``read_records``
reads the records by byte range.

Files are written and read inside tasks through Arrow's file systems (local or mounted
paths and the object stores that Arrow knows) under a shared folder.  A task names its
files by a fresh id and only rows of finished tasks enter the index, so a lost executor
leaves at most an unused file.

Cases: a null payload is empty; a null URL has an empty key and no target URI; line
breaks and control bytes in URLs are percent-encoded in headers; repeated rows are
records of their own; rows that share the smallest id of a payload are all responses; a
null id never stands for a group while others have ids; empty tables give an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import checkpointed, stored

LEAST_REVISIT = 100
ROTATE = 1 << 30
#: Least lines of a block; the number of directory entries that blocks grow to keep.
BLOCK_LINES, DIRECTORY = 300, 1 << 16
#: Payload groups up to this many are broadcast to the writers.
BROADCAST_GROUPS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)


class Archive(NamedTuple):
    """Directory entries: first (key, id) and file, offset, length of each block."""
    starts: list[tuple[bytes, int]]
    blocks: list[tuple[str, int, int]]


def store_at(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a folder name as Spark writes it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def surt(url: Column) -> Column:
    """Reversed-host key: ``net,example,www)/path?query``; else the text itself."""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(url.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","),
                                                F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit("")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           first: bool, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    body = http + payload if first else http
    head = [f"WARC-Type: {'response' if first else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if not first:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record as it was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page = fields["WARC-Record-ID"][10:-1]
    first = fields["WARC-Type"] == "response"
    return {"page_id": None if page == "none" else int(page), "payload_bytes": length,
            "payload_digest": hashlib.sha256(payload).hexdigest() if first
            else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "record_type": fields["WARC-Type"],
            "refers_to": None if first else int(fields["WARC-Refers-To"][10:-1]),
            "payload": payload if first else None}


def with_first(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, payload, digest, first_id): first_id is the least id of the rows
    with an equal payload of revisit size, null where there is no other."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"),
                        F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = checkpointed(rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest")
                          .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
                          .where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"))
    few = groups.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, "digest", "left")


def write_records(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; returns (key, page_id, file, offset, length) per record."""
    rows = with_first(pages, id_col, url_col, payload_col).select(
        "page_id", "url", "payload", "digest", "first_id", surt(F.col("url")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_at(path)
        fs.create_dir(f"{root}/warc", recursive=True)
        file = out = None
        at = 0
        for b in batches:
            places = []
            for page_id, url, payload, digest, first_id in zip(*[c.to_pylist() for c in b.columns[:5]]):
                if out is None or at > ROTATE:
                    if out is not None:
                        out.close()
                    file, at = f"warc/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{file}", compression=None)
                first = first_id is None or first_id == page_id
                member = gzip.compress(record(page_id, url, payload, digest, first_id, first, date), 4, mtime=0)
                out.write(member)
                places.append((file, at, len(member)))
                at += len(member)
            if places:
                files, offsets, lengths = zip(*places)
                yield pa.RecordBatch.from_arrays(
                    [b.column(5), b.column(0), pa.array(files), pa.array(offsets, pa.int64()),
                     pa.array(lengths, pa.int64())], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    # stored only after the files are closed: rows of a failed task never enter the index
    return stored(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"),
                  "warc-captures")


def write_index(captures: DataFrame, path: str) -> Archive:
    """Sort the captures by key and id, write compressed blocks, return the directory."""
    lines = max(BLOCK_LINES, -(-captures.count() // DIRECTORY))
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    srt = (captures.withColumn("page_id", F.coalesce("page_id", F.lit(NO_ID)))
           .repartitionByRange(parts, "key", "page_id", "file", "offset")
           .sortWithinPartitions("key", "page_id", "file", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_at(path)
        fs.create_dir(f"{root}/index", recursive=True)
        file, out, at, held, found = f"index/{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def close_block():
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{root}/{file}", compression=None)
            block = gzip.compress("\n".join(map(json.dumps, held)).encode(), 6, mtime=0)
            out.write(block)
            found.append((held[0][0], held[0][1], file, at, len(block)))
            at += len(block)
            held.clear()

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                held.append(row)
                if len(held) == lines:
                    close_block()
        if held:
            close_block()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(),
                                                              pa.int64(), pa.int64()))],
                ["key", "page_id", "file", "offset", "length"])

    directory = stored(srt.mapInArrow(run, captures.schema), "warc-directory")
    rows = sorted((r.key.encode(), r.page_id, r.file, r.offset, r.length) for r in directory.collect())
    return Archive([r[:2] for r in rows], [r[2:] for r in rows])


def write_archive(pages: DataFrame, path: str, **columns) -> Archive:
    """Write records and index of ``pages`` under ``path``; returns the directory."""
    return write_index(write_records(pages, path, **columns), path)


def lookup(wanted: DataFrame, archive: Archive, path: str) -> DataFrame:
    """Captures of the wanted (url, page_id) pairs: (page_id, file, offset, length).
    Every capture of a pair is returned once, however often the pair is wanted."""
    shared = wanted.sparkSession.sparkContext.broadcast((archive.starts, archive.blocks))
    pairs = wanted.select(surt(F.col("url")).alias("key"),
                          F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).distinct()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, _ = shared.value
        for b in batches:
            row, block = [], []
            for i, pair in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                want = (pair[0].encode(), pair[1])
                for k in range(max(bisect_left(starts, want) - 1, 0), bisect_right(starts, want)):
                    row.append(i)
                    block.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()),
                                              *b.take(pa.array(row, pa.int32())).columns],
                                             ["block", "key", "page_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, blocks = shared.value
        fs, root = store_at(path)
        now, entries = None, {}
        for b in batches:
            out = []
            for block, key, page_id in zip(*[c.to_pylist() for c in b.columns]):
                if block != now:
                    now, entries = block, {}
                    file, offset, length = blocks[block]
                    for line in gzip.decompress(byte_range(fs, f"{root}/{file}", offset, length)).split(b"\n"):
                        k, i, *place = json.loads(line)
                        entries.setdefault((k, i), []).append(place)
                out += [(None if page_id == NO_ID else page_id, *p) for p in entries.get((key, page_id), [])]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(),
                                                                pa.int64()))],
                    ["page_id", "file", "offset", "length"])

    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pairs.mapInArrow(find, "block int, key string, page_id long")
            .repartition(parts, "block").sortWithinPartitions("block")
            .mapInArrow(read, "page_id long, file string, offset long, length long"))


def byte_range(fs: pafs.FileSystem, file: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(file) as f:
        return f.read_at(length, offset)


def read_records(places: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """Read records by byte range, file by file in order of offset: page_id,
    payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names, types = names[:6 if payloads else 5], types[:6 if payloads else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store_at(path)
        now, f = None, None
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                out = []
                for file, offset, length in zip(*[c.to_pylist() for c in b.slice(lo, 500).columns]):
                    if file != now:
                        if f is not None:
                            f.close()
                        now, f = file, fs.open_input_file(f"{root}/{file}")
                    got = parse(zlib.decompress(f.read_at(length, offset), 31))
                    out.append([got[k] for k in names])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if f is not None:
            f.close()

    # about 64 MB of a file to a range, so that one large file spreads over tasks
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = F.shiftright("offset", 26)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return (places.select("file", "offset", "length").repartition(parts, "file", near)
            .sortWithinPartitions("file", "offset").select("file", "offset", "length")
            .mapInArrow(run, schema + (", payload binary" if payloads else "")))
