"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offsets.

`normalise` inflates a whole-file gzip stream once, front to back, and rewrites every record
as a gzip member of its own, with a sidecar index of offsets beside the archive. Memory holds
one record at a time. Every file is written under a name of its attempt and then moved, so a
task that runs again replaces its file with the same bytes. All paths are URIs (pyarrow.fs).

Records are responses or revisits. Of pages with equal payloads of at least REVISIT_BYTES the
one with the largest page_id is the response and the others revisit it; rows that repeat that
page_id are responses too, and pages without any page_id are all responses. Null html is an
empty payload, a null url leaves out the target, control characters in a url are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._common import for_workers, materialize, shared_path

REVISIT_BYTES = 1000
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records long, bytes long"


def record_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to). Html moves only where it must meet many repeated payloads."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    repeated = own.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 and last is not null")
    repeated = materialize(repeated.select(F.col("digest").alias("_d"), "last"), "warc-repeated")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return own.join(repeated, F.col("digest") == F.col("_d"), "left").select(
        "page_id", "url", "html", "digest", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("last")).alias("refers_to")
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header only, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = {"WARC-Type": kind, "WARC-Record-ID": name(page_id), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    if kind == "revisit":
        head |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _stored(folder: str, name: str, suffixes: tuple[str, ...]):  # noqa: ANN202
    """Streams under attempt names, and a function that moves them to their final ones."""
    task = TaskContext.get()
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own = [f"{root}/.{name}.{task.taskAttemptId() if task else 0}{s}" for s in suffixes]
    streams = [fs.open_output_stream(p, compression=None) for p in own]

    def done() -> None:
        for s, p, suffix in zip(streams, own, suffixes, strict=True):
            s.close()
            fs.move(p, f"{root}/{name}{suffix}")

    return streams, done


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """One whole-file gzip archive for each partition; returns the materialised list of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n, size = f"part-{TaskContext.get().partitionId():06d}", None, 0, 0
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, digest, kind, to = (c[i].as_py() for c in cols)
                if out is None:
                    (out,), done = _stored(folder, name, (".warc.gz",))
                data = gz.compress(record(page, url, html.encode(), digest, kind, to))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            data = gz.flush()
            out.write(data)
            done()
            yield _listed(f"{folder}/{name}.warc.gz", n, size + len(data))

    return materialize(records.mapInArrow(run, _MANIFEST), "warc-written")


def _listed(path: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})


def inflated(read) -> Iterator[bytes]:  # noqa: ANN001
    """Plain bytes of a gzip stream of one or more members; read() gives the next chunk."""
    z = zlib.decompressobj(31)
    while chunk := read():
        while chunk:
            if data := z.decompress(chunk):
                yield data
            chunk = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
                continue
            break
    if data := z.flush():
        yield data


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive."""
    held = bytearray()
    chunks = iter(chunks)
    more = lambda: held.extend(c) or True if (c := next(chunks, None)) is not None else False
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
        length = re.search(rb"(?im)^Content-Length:\s*(\d+)", held[:end])
        if not held.startswith(b"WARC/") or not length:
            raise ValueError("no WARC record where one should start")
        whole = end + 4 + int(length[1]) + 4
        while len(held) < whole:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:whole])
        del held[:whole]


def header(rec: bytes) -> dict[str, str]:
    lines = rec[: rec.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def rewrite(read, write) -> Iterator[tuple[str, str, int, int]]:  # noqa: ANN001
    """Writes each record as its own member; yields (record id, type, offset, length)."""
    at = 0
    for rec in split_records(inflated(read)):
        gz = zlib.compressobj(4, zlib.DEFLATED, 31)
        member, head = gz.compress(rec) + gz.flush(), header(rec)
        write(member)
        yield head["warc-record-id"], head["warc-type"], at, len(member)
        at += len(member)


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Archives of single-record members with `.idx` sidecars; returns the materialised list of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                name = place.rpartition("/")[2].removesuffix(".warc.gz")
                n = size = 0
                with fs.open_input_stream(place, compression=None) as source:
                    (archive, index), done = _stored(folder, name, (".warc.gz", ".idx"))
                    for rid, kind, offset, length in rewrite(lambda: source.read(CHUNK), archive.write):  # noqa: B023
                        index.write(f"{offset}\t{length}\t{kind}\t{rid}\n".encode())
                        n, size = n + 1, offset + length
                    done()
                yield _listed(f"{folder}/{name}.warc.gz", n, size)

    return materialize(_spread(manifest).mapInArrow(run, _MANIFEST), "warc-normalised")


def _spread(manifest: DataFrame) -> DataFrame:
    """One file a task, whatever the number of files that list them."""
    return manifest.repartitionByRange(min(max(1, manifest.count()), 100_000), "path")


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records through their sidecars: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda urn: int(n) if (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None

    def rows(path: str) -> Iterator[tuple]:
        fs, place = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(place.removesuffix(".warc.gz") + ".idx", compression=None) as f:
            index = f.read().decode().splitlines()
        with fs.open_input_file(place) as f:
            for line in index:
                offset, length, _, _ = line.split("\t")
                f.seek(int(offset))
                rec = zlib.decompress(f.read(int(length)), 31)
                head = header(rec)
                block = rec[rec.index(b"\r\n\r\n") + 4 : -4]
                at = block.index(b"\r\n\r\n") + 4
                told = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if head["warc-type"] == "response":
                    payload = block[at:]
                    size, digest = len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                    if digest != told:
                        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                else:
                    payload, size, digest = None, int(re.search(rb"(?im)^Content-Length:\s*(\d+)", block)[1]), told
                yield number(head["warc-record-id"]), head.get("warc-target-uri"), payload, size, digest, head["warc-type"], number(head["warc-refers-to"]) if "warc-refers-to" in head else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for r in rows(path):
                    held.append(r)
                    size += len(r[2] or b"")
                    if size > CHUNK * 4 or len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return _spread(manifest).mapInArrow(run, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages to monolithic archives, normalises those, drops them, and returns the list of files."""
    spark = pages.sparkSession
    whole = for_workers(shared_path(spark, "warc-monolithic"))
    manifest = normalise(write_monolithic(record_types(pages), whole), for_workers(shared_path(spark, "warc")))
    fs, root = pafs.FileSystem.from_uri(whole)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        fs.delete_dir(root)
    return manifest
